"""Byte-level BPE encoding and decoding.

A text is cut into words by a public pattern and each word is merged by rank, the lowest first and the leftmost
of equals, as the tiktoken library does it.  The most frequent words of the corpus, about VOCABULARY_ROWS, are
merged once in Spark and broadcast: a higher-order fold replaces, in the order of their ranks, the pairs that the
literal rank map holds for the substrings of a word's bytes.  A worker merges every other word itself by the same
rule, so the bound changes where a word is merged and not the result.

One pass over the ranks is enough: what a merge makes can only be part of pieces that were learned later, so a new
pair never has a lower rank than the merge that made it.  A vocabulary in which a piece doesn't come of its own
pair is refused.  Decoding concatenates the binary pieces of the ids.  Null texts count as empty; an empty text has
no ids; equal texts have equal ids; an empty table gives no rows.  Columns that clash with those added give way.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import computed, discard, written

VOCABULARY_ROWS, MEMO_WORDS, MEMO_BYTES = 1 << 17, 1 << 16, 48
#: Buckets of the literal rank map (Spark searches a map type from end to end), bytes of a word that are looked up at a time.
BUCKETS, SPAN = 1 << 14, 256
_PIECE, _RANK, _BUCKET = "\ue000", "\ue001", "\ue002"  # what stands before a piece, between it and its sign, between buckets


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: a heap of adjacent pairs by (rank, place), entries of merged parts being skipped."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    stop = list(range(1, n + 1))  # end of the part that begins here, 0 once it is merged away
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, end = heapq.heappop(heap)
        right = after[k]
        if not stop[k] or right >= n or stop[right] != end:
            continue
        stop[k], stop[right], after[k] = end, 0, after[right]
        if after[k] < n:
            before[after[k]] = k
            if (r := ranks.get(word[k : stop[after[k]]])) is not None:
                heapq.heappush(heap, (r, k, stop[after[k]]))
        if (left := before[k]) >= 0 and (r := ranks.get(word[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, k = [], 0
    while k < n:
        out.append(ranks[word[k : stop[k]]])
        k = after[k]
    return out


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n) over all texts; the pattern's classes are Unicode's."""
    words = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit("(?U)" + pattern), F.lit(0)))
    return docs.select(words.alias("word")).filter(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))


def pair_of(piece: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two pieces whose merge makes a piece: what is left of its bytes after all merges of lower rank."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 2:
        rank, k = min((ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= ranks[piece]:
            raise ValueError(f"piece {piece!r} of rank {ranks[piece]} does not come of a pair of its own")
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def sign(rank: int) -> str:
    """The character that stands for a piece: in the order of ranks, past Latin-1 and around the surrogates."""
    code = rank + 256
    return chr(code if code < 0xD800 else code + 0x2000)  # the private characters above stand between entries


def rank_of(signs: str) -> np.ndarray:
    code = np.frombuffer(signs.encode("utf-32-le"), "<u4")
    return (np.where(code < 0xD800, code, code - 0x2000) - 256).astype("<u4")


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: of each piece of two bytes or more (as Latin-1) its sign, as text in buckets by a checksum of the piece."""
    buckets = [""] * BUCKETS
    for p, r in ranks.items():
        if len(p) > 1:
            key = p.decode("latin-1")
            buckets[zlib.crc32(key.encode()) % BUCKETS] += _PIECE + key + _RANK + sign(r)
    return F.split(F.lit(_BUCKET.join(buckets)), _BUCKET)


def look_up(table: Column, piece: Column) -> Column:
    """The sign of a piece; what isn't a sign (nothing, or the mark before a piece) if the map doesn't have it."""
    bucket = F.get(table, (F.crc32(piece) % BUCKETS).cast("int"))
    return F.substring(F.call_function("substring_index", bucket, F.concat(F.lit(_PIECE), piece, F.lit(_RANK)), F.lit(-1)), 1, 1)


def fold_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word) -> word, ids array<int>: the ranked merges of a word as a fold, without leaving the JVM.

    The bytes of a word are a string of signs.  The substrings that the rank map holds are its possible merges; folded
    in the order of their ranks, each replaces its pair of signs, from left to right, by its own.

    Spark puts the text of literals into each description of a plan, copied once more by every level of nesting, and
    describes adaptive plans at each change.  So the maps are bound at the root, once; words had better be a written table.
    """
    longest = max(map(len, ranks))
    made = {r: "".join(sign(ranks[x]) for x in pair_of(p, ranks)) for p, r in ranks.items() if len(p) > 1}
    made_of = F.split(F.lit(_PIECE.join(made.get(r, "") for r in range(max(ranks.values()) + 1))), _PIECE)
    substrings = lambda x, starts: F.flatten(F.transform(
        starts, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.length(x) - i + 1, F.lit(longest))), lambda n: F.substring(x, i, n))))
    w, n = F.col("latin"), F.length("latin")
    signs = F.translate(w, "".join(map(chr, range(256))), "".join(sign(ranks[bytes([b])]) for b in range(256)))
    at = lambda c: let(F.ascii(c), lambda k: F.when(k < 0xD800, k).otherwise(k - 0x2000) - 256)

    def fold(maps: Column) -> Column:
        table, pairs = F.get(maps, 0), F.get(maps, 1)
        found = lambda subs: F.array_distinct(F.transform(subs, lambda p: look_up(table, p)))

        def in_spans(w: Column) -> Column:
            """The signs found in a long word, a span of its bytes at a time; spans reach into the next as far as a piece may."""
            span = lambda k: F.substring(w, k * SPAN + 1, F.lit(SPAN + longest - 1))
            one = lambda x: found(F.array_distinct(substrings(x, F.sequence(F.lit(1), F.least(F.lit(SPAN), F.length(x) - 1)))))
            spans = F.sequence(F.lit(0), F.floor((F.length(w) - 2) / SPAN).cast("int"))
            return F.array_distinct(F.flatten(F.transform(spans, lambda k: let(span(k), one))))

        every = F.when(n <= SPAN, found(substrings(w, F.sequence(F.lit(1), n - 1)))).otherwise(in_spans(w))
        merges = F.filter(F.array_sort(every), lambda c: ~c.isin("", _PIECE))
        folded = F.when(n < 2, signs).otherwise(F.aggregate(merges, signs, lambda s, c: F.replace(s, F.get(pairs, at(c)), c)))
        return F.when(n > 0, F.transform(F.split(folded, ""), at)).otherwise(F.array().cast("array<int>"))

    base = words.select("word", F.decode(F.encode("word", "UTF-8"), "ISO-8859-1").alias("latin"))  # a character for each byte
    return base.select("word", let(F.array(rank_map(ranks), made_of), fold).alias("ids"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def most_frequent(counts: DataFrame, rows: int) -> DataFrame:
    """(word) of the words (word, n) that occur most, about `rows` of them: a cut on n, and one on a hash of those at the cut.

    No task sorts words and the driver sees how often each number occurs, in steps of a hundredth beyond a hundred.
    """
    step = F.when(F.col("n") < 100, F.col("n")).otherwise(F.floor(F.log("n") * 100) + 100).cast("long")
    left, cut, share = rows, 0, 1.0
    for at, n in sorted(map(tuple, counts.groupBy(step.alias("step")).agg(F.count("*")).collect()), reverse=True):
        if n > left:
            cut, share = at, left / n
            break
        left -= n
    low = F.xxhash64("word") <= F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * share)))
    return counts.filter((step > cut) | (step == cut) & low).select("word")


def vocabulary(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> dict[str, bytes]:
    """The ids of the words that occur most, as little-endian 32-bit bytes: VOCABULARY_ROWS of them, or hardly more."""
    counts = written(word_counts(docs, pattern), "counts")
    common = most_frequent(counts, VOCABULARY_ROWS)
    cores = common.sparkSession.sparkContext.defaultParallelism
    spread = written(common.repartition(max(2, cores * 2)), "common")  # the fold by itself has no exchange, so its plan never changes
    folded = written(fold_words(spread, ranks), "folded")  # by all cores: an iterator would run one partition after another
    memo = {r["word"]: np.asarray(r["ids"], "<u4").tobytes() for r in folded.toLocalIterator()}
    discard(counts, spread, folded)
    return memo


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    by_rank = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_rank[rank] = piece
    return by_rank


def _encoder(known: dict[str, bytes], ranks: dict[bytes, int], pattern: str) -> Callable[[list], list[bytes]]:
    words, memo = regex.compile(pattern), {}

    def miss(word: str) -> bytes:
        out = np.asarray(merge(word.encode("utf-8", "surrogatepass"), ranks), "<u4").tobytes()
        if len(word) <= MEMO_BYTES:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            memo[word] = out
        return out

    return lambda texts: [b"".join([known.get(w) or memo.get(w) or miss(w) for w in words.findall(t)]) if t else b"" for t in texts]


def _decoder(pieces: list[bytes]) -> Callable[[list], list[bytes]]:
    piece = pieces.__getitem__
    return lambda rows: [b"".join(map(piece, np.frombuffer(i or b"", "<u4").tolist())) for i in rows]


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> the columns of docs, n_tokens long, ids binary (little-endian unsigned 32-bit).

    decoded: the ids are decoded again in the same pass, as column decoded.
    """
    ranks = load_ranks(ranks_path)
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary(docs, ranks, pattern), ranks))

    def setup() -> Callable[[list], tuple]:
        to_ids, back = _encoder(*shipped.value, pattern), _decoder(_pieces(shipped.value[1])) if decoded else None

        def work(texts: list[str | None]) -> tuple:
            ids = to_ids(texts)
            return [len(i) // 4 for i in ids], ids, *([back(ids)] if back else [])

        return work

    added = {"n_tokens": "long", "ids": "binary"} | ({"decoded": "binary"} if decoded else {})
    return computed(docs, "text", [c for c in docs.columns if c.lower() not in added], ", ".join(f"{c} {t}" for c, t in added.items()), setup)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds column decoded: the concatenated bytes of the pieces that ids names (null ids: no bytes)."""
    pieces = encoded.sparkSession.sparkContext.broadcast(_pieces(load_ranks(ranks_path)))

    def setup() -> Callable[[list], tuple]:
        back = _decoder(pieces.value)
        return lambda rows: (back(rows),)

    return computed(encoded, "ids", [c for c in encoded.columns if c.lower() != "decoded"], "decoded binary", setup)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of docs (an empty table gives none)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = encode(slim, ranks_path, pattern, decoded=True).drop("text")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
