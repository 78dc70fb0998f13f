"""MinHash document fingerprints.

A document's words are the runs of bytes other than ASCII white space, ASCII letters folded; its shingles are
the runs of five words (fewer words: the whole sequence; none: no shingle).  Its signature holds the least value
of each of PERMUTATIONS universal hash functions over all its shingles.  Null and empty texts have the signature
of the empty set; the likeness of two empty sets is 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import blocked, computed, join_classes, present, small_batches, whole_groups, written
from .graph import connected_components
from .tokens import mix, shingles, word_hashes

PERMUTATIONS, WORDS, SIMILARITY, BANDS = 128, 5, 0.8, 32
#: Rows of an ordered bucket, and buckets at most: their bounds are all the driver holds.
BUCKET_ROWS, MOST_BUCKETS, PART_ROWS = 500, 65_536, 2_000
_EMPTY = np.iinfo(np.uint64).max
_rng = np.random.default_rng(20_240_229)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def least(shingle: np.ndarray, block: int = 512) -> np.ndarray:
    """Least value of each universal hash function a * x + b over the shingles (multiply-shift, 32-bit x)."""
    low = np.full(PERMUTATIONS, _EMPTY, np.uint64)
    x = shingle >> np.uint64(32)
    for k in range(0, len(x), block):
        np.minimum(low, (_A[:, None] * x[None, k : k + block] + _B[:, None]).min(axis=1), out=low)
    return low


def signature(text: str | None) -> np.ndarray:
    return least(shingles(word_hashes([text])[0], WORDS))


def as_string(low: np.ndarray) -> str:
    """Sixteen bits of a hash of each whole least value, in hexadecimal; the empty set's are all ones.

    The first bits of the least values themselves won't do: the least of n values is about 2**64 / n, so those of
    long texts nearly all begin with zeros.
    """
    return (np.where(low == _EMPTY, low, mix(low)) >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of least values that agree in all bits, an estimate of the Jaccard similarity."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_chars, fingerprint: one row per row of docs."""

    def work(texts: list[str | None]) -> tuple:
        words, bounds = word_hashes(texts)
        each = [as_string(least(shingles(words[a:b], WORDS))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [len(t or "") for t in texts], each

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return computed(slim, "text", ["doc_id"], "n_chars long, fingerprint string", lambda: work)


def edited(text: str, after: str) -> str:
    """text whose last quarter of code points is replaced by the first as many of the text after it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


class _Signed:
    __slots__ = ("doc_id", "low", "shingle", "text")

    def __init__(self, doc_id: int | None, text: str, shingle: np.ndarray) -> None:
        self.doc_id, self.text, self.shingle, self.low = doc_id, text, shingle, least(shingle)


def _row(doc: _Signed, after: _Signed) -> tuple:
    text = edited(doc.text, after.text)
    changed = shingles(word_hashes([text])[0], WORDS)
    m = min(len(changed), len(doc.shingle))
    differ = np.flatnonzero(changed[:m] != doc.shingle[:m])
    same = int(differ[0]) if len(differ) else m
    if same == len(doc.shingle) == len(changed):
        low = doc.low
    else:  # what both begin with need not be hashed again beyond this once
        low = np.minimum(least(changed[:same]), least(changed[same:]))
    sha = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    return doc.doc_id, len(doc.text), sha, as_string(doc.low), as_string(low), likeness(doc.low, low), likeness(doc.low, after.low)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of sorted buckets, each closed by the first row of the next bucket, one text held at a time."""
    before, bucket = None, None
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for f in frames:
        texts = [t if isinstance(t, str) else "" for t in f["text"]]
        words, bounds = word_hashes(texts)
        out = []
        for k, (b, closing, doc_id) in enumerate(zip(f["bucket"], f["closing"], f["doc_id"], strict=True)):
            if b != bucket:
                before, bucket = None, b
            elif before is None:  # the bucket is closed: more rows with the closing id
                continue
            doc = _Signed(doc_id and int(doc_id), texts[k], shingles(words[bounds[k] : bounds[k + 1]], WORDS))
            if before is not None:
                out.append(_row(before, doc))
            before = None if closing else doc
        made = pd.DataFrame(out, columns=names)
        made["doc_id"] = pd.array([r[0] for r in out], "Int64")
        yield made


def ordered_buckets(docs: DataFrame) -> DataFrame | None:
    """docs with columns bucket (rising with doc_id) and closing; each bucket ends with the next one's first row.

    One shuffle of the texts.  The driver sees bucket bounds and first ids only, MOST_BUCKETS of each at most.
    """
    from pyspark.ml.feature import Bucketizer  # workers don't need it

    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), present(F.col("text")).alias("text")).withColumn("place", order.cast("double"))
    n = docs.select("place").count()
    if not n:
        return None
    buckets = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = sorted(set(docs.agg(F.percentile_approx("place", [k / buckets for k in range(1, buckets)] or [0.5], 10 * buckets)).first()[0]))
    docs = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="at").transform(docs)
    docs = docs.withColumn("bucket", F.col("at").cast("int"))
    least_key = F.min(order).alias("first_key")
    firsts = [(r["bucket"], r["first_key"]) for r in docs.groupBy("bucket").agg(least_key).orderBy("bucket").collect()]
    closes = [(firsts[k - 1][0], key) for k, (_, key) in enumerate(firsts)]
    closers = F.broadcast(spark.createDataFrame(closes, "bucket int, first_key long"))
    ends = docs.drop("bucket").join(closers, order == F.col("first_key")).select("bucket", F.lit(True).alias("closing"), "doc_id", "text")
    rows = docs.select("bucket", F.lit(False).alias("closing"), "doc_id", "text").unionByName(ends)
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "closing", F.asc_nulls_first("doc_id"), "text")
    return rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would make floats of longs beside nulls


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text, and give their likeness and that to the next document.

    Next is by ascending doc_id, a null id first, rows with one id by text; after the last comes the first (a
    lone row is its own next).  An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = ordered_buckets(docs)
    if rows is None:
        return spark.createDataFrame([], COLUMNS)
    return rows.mapInPandas(_stream, COLUMNS)


def band_values(low: np.ndarray) -> list[int]:
    """One value for each of the BANDS runs of least values."""
    part = low.reshape(BANDS, -1)
    return (part * _A[: part.shape[1]]).sum(axis=1, dtype=np.uint64).astype(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, component_id: equal texts share a class, classes link at a Jaccard of similarity or more.

    Texts with no words form one class per text and link with nothing else.  Signature bands are joined by
    their values; in each block of a band's rows the shingle sets are compared and only a spanning forest of
    the verified links leaves the task, so no group's pairs are emitted.  A pair that agrees in no band is not
    compared: with 32 bands of 4 rows that is expected of (1 - s**4)**32 of the pairs of Jaccard s, 5e-8 at 0.8.

    One row per row of docs: null texts are as empty ones; a class whose ids are all null has null ids and links with
    nothing; repeated rows and ids keep a row each.  Columns other than doc_id and text are ignored; an empty table
    gives no rows.
    """
    def sign(texts: list[str]) -> tuple:
        words, bounds = word_hashes(texts)
        sets = [np.unique(shingles(words[a:b], WORDS)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [band_values(least(s)) if len(s) else [] for s in sets], [s.tobytes() for s in sets]

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), present(F.col("text")).alias("text")).withColumn("digest", F.sha2("text", 256))
    classes = written(base.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("text").alias("text")), "classes")
    signed = written(computed(classes.filter("class_id IS NOT NULL"), "text", ["class_id"], "band_values array<bigint>, shingle_set binary", lambda: sign), "signed")
    banded = signed.select("class_id", F.posexplode("band_values").alias("band", "band_value"))
    deal = blocked(banded, ["band", "band_value"], "class_id", PART_ROWS).join(signed.select("class_id", "shingle_set"), "class_id")
    keys = ["group_key", "left_part", "right_part"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys):
            for _, g in f.groupby(keys):
                ids = g["class_id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                sets = [np.frombuffer(g["shingle_set"].iloc[k], np.uint64) for k in order]
                sizes, label, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
                for j in range(1, len(sets)):
                    # a pair is compared unless links found before join it, or one set is too small for the other
                    alike = np.minimum(sizes[:j], sizes[j]) >= similarity * np.maximum(sizes[:j], sizes[j])
                    for i in np.flatnonzero(alike):
                        if label[i] != label[j] and jaccard(sets[i], sets[j]) >= similarity:
                            label[label == label[j]] = label[i]
                            out.append((ids[order[j]], ids[order[i]]))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = deal.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(verify, "a long, b long").distinct()
    comps = connected_components(links).withColumnRenamed("node", "class_id")
    named = classes.select("digest", "class_id", "copies").join(comps, "class_id", "left")
    named = written(named.withColumn("component_id", F.coalesce("component", "class_id")).drop("component"), "named")
    return join_classes(base.select("doc_id", "digest"), named, "digest", "copies").drop("digest")
