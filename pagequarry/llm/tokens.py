"""Vectorised hashing of words and byte n-grams over many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes hashed together; a longer text is cut at white space.
CHUNK = 1 << 18
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits ends a word; bytes of other scripts don't.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1024), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that lets every input bit reach every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(data: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each run of bytes that aren't gap, from one pass of prefix sums."""
    n = len(data)
    edge = np.diff(np.concatenate(([True], gap[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def cut(blob: bytes, limit: int | None = None) -> Iterator[bytes]:
    """Pieces of at most about limit bytes that end at ASCII white space; a longer word stays whole."""
    limit = limit or CHUNK
    while len(blob) > limit:
        at = max(blob.rfind(c, 1, limit) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if at < 0:
            at = min((p for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (p := blob.find(c, limit)) >= 0), default=-1)
        if at < 0:
            break
        yield blob[:at]
        blob = blob[at:]
    yield blob


def packed(texts: Iterable[str | None], limit: int | None = None) -> Iterator[tuple[list[int], list[bytes]]]:
    """Pieces of texts with the position of their text, in groups of about limit bytes."""
    limit = limit or CHUNK
    where, blobs, held = [], [], 0
    for k, text in enumerate(texts):
        for piece in cut((text or "").encode("utf-8", "surrogatepass"), limit):
            if held + len(piece) > limit and where:
                yield where, blobs
                where, blobs, held = [], [], 0
            where.append(k)
            blobs.append(piece)
            held += len(piece) + 3
    if where:
        yield where, blobs


def word_hashes(texts: list[str | None], gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order (ASCII letters folded), and len(texts) + 1 bounds."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for where, blobs in packed(texts):
        data = LOWER[np.frombuffer(b" ".join(blobs), np.uint8)]
        h, starts = hash_words(data, gap)
        first = np.cumsum([0, *(len(x) + 1 for x in blobs)])
        np.add.at(counts, where, np.diff(np.searchsorted(starts, first)))
        hashes.append(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words; fewer words make one run, none none."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + len(h)]
    return mix(h)


def gram_scores(texts: list[str | None], table: np.ndarray, n: int, gap: np.ndarray | None, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums of table rows over the byte n-grams of each text, and the numbers of n-grams.

    table has a power of two of rows; an n-gram's row is its hash.  gap: bytes read as a blank, runs of which
    count as one.  The sums don't depend on the texts that share a batch.
    """
    bits = np.uint64(64 - (len(table).bit_length() - 1))
    sums, counts = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for where, blobs in packed(texts):
        at, index = gram_index(blobs, n, gap, fold, bits)
        of = np.asarray(where)
        bounds = np.searchsorted(at, np.cumsum([0, *(len(x) + 3 for x in blobs)]))
        got = np.diff(bounds)
        full = got > 0
        if full.any():
            np.add.at(sums, of[full], np.add.reduceat(table[index], bounds[:-1][full], axis=0, dtype=np.float64))
            np.add.at(counts, of, got)
    return sums, counts


def gram_index(blobs: list[bytes], n: int, gap: np.ndarray | None, fold: bool, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Place and table row of each n-gram; a piece owns the bytes from the blank before it to the two after."""
    data = np.frombuffer(b" " + b"   ".join(blobs) + b"   " + b" " * n, np.uint8)
    if fold:
        data = LOWER[data]
    blank = data == 0x20
    if gap is not None:
        blank = gap[data]
        data = np.where(blank, np.uint8(0x20), data)
    m = len(data) - n
    code = np.zeros(m, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | data[j : j + m]
    use = np.flatnonzero(~(blank[:m] & blank[1 : m + 1]))
    return use, ((code[use] * np.uint64(_MULTIPLIER)) >> bits).astype(np.int64)
