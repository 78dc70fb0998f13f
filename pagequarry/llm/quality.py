"""Quality by importance resampling.

Two generative models of hashed n-grams are counted, one of the target (rows labelled good, a bounded sample) and
one of all raw texts: byte 4-grams, and whether a word repeats the one before it.  A document's log ratio is that of
its likelihoods under both, as a mean over its n-grams so that length doesn't decide.  Its log weight is the log odds,
calibrated on labelled rows, that a text of this ratio is good.

Documents are drawn without replacement by Gumbel top-k: the k largest log weights plus Gumbel noise stay, k being the
number of good documents that the weights expect among all of them.  Labelled rows needn't be a fair sample: the odds
are shifted to the share of good texts under which the ratios of the whole corpus are likeliest.  Where good and bad texts lie apart the draw hardly
errs, in between chance decides: a document of even odds is kept in about half of the seeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import computed, fresh, least_hashes, present, small_batches, written
from .tokens import gram_index, gram_scores, packed, word_hashes

BUCKET_BITS, GRAM, SEED = 15, 4, 99
#: Labelled rows of each kind that are learned from at most; each is read whole.
SAMPLE_ROWS = 4_000
#: Of the squared slope, in standard deviations of the ratio, against the log loss of all labelled rows together.
RIDGE = 0.01
SAME, NEXT = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + 1
BUCKETS = NEXT + 1


def counts(texts: list[str | None]) -> np.ndarray:
    """Occurrences of each hashed n-gram in all texts, then of repeated words and of other word pairs."""
    out = np.zeros(BUCKETS, np.int64)
    for _, blobs in packed(texts):
        out[:SAME] += np.bincount(gram_index(blobs, GRAM, None, False, np.uint64(64 - BUCKET_BITS))[1], minlength=SAME)
    same, pairs = repeats(texts)
    out[SAME], out[NEXT] = same.sum(), pairs.sum() - same.sum()
    return out


def repeats(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many words repeat the one before, and how many have one before."""
    h, bounds = word_hashes(texts)
    like = np.concatenate(([0], np.cumsum(h[1:] == h[:-1]), [0]))  # like[k]: of words 1..k
    last = np.maximum(bounds[1:] - 1, 0)
    pairs = np.maximum(np.diff(bounds) - 1, 0)
    return np.where(pairs > 0, like[last] - like[np.minimum(bounds[:-1], last)], 0), pairs


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """counts() of every text of docs; tasks send their sums, the driver gets one number per bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += counts(batch.column("text").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log ratio of each bucket
    slope: float = 0.0  # of the log odds over a text's mean ratio; 0 and 0 where nothing was learned
    level: float = 0.0
    share: float = 0.5  # of good rows among the labelled ones

    def mean_ratio(self, texts: list[str | None]) -> np.ndarray:
        """Mean log ratio over a text's n-grams; 0 for a text that has none."""
        sums, n = gram_scores(texts, self.ratio[:SAME, None], GRAM, None, False)
        same, pairs = repeats(texts)
        return (sums[:, 0] + same * self.ratio[SAME] + (pairs - same) * self.ratio[NEXT]) / np.maximum(n, 1)

    @property
    def learned(self) -> bool:
        return self.slope > 0


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = 1.0) -> np.ndarray:
    """Smoothed log ratio of both models; n-grams and word pairs are separate distributions."""
    out = np.zeros(BUCKETS)
    for part in (slice(0, SAME), slice(SAME, BUCKETS)):
        share = lambda c: (c[part] + prior) / (c[part].sum() + prior * len(c[part]))  # noqa: B023, E731
        out[part] = np.log(share(target)) - np.log(share(raw))
    return out


def calibrate(ratio: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of the log odds that a row is good: ridge logistic regression on the ratio, by Newton steps.

    weight: how many labelled rows a sampled one stands for.  0 and 0 without rows of both kinds, or if good rows
    have no higher ratios than bad ones: nothing is learned then.
    """
    if len(ratio) < 2 or good.all() or not good.any() or not np.ptp(ratio):
        return 0.0, 0.0
    middle, scale = np.average(ratio, weights=weight), ratio.std()
    x = np.stack([(ratio - middle) / scale, np.ones(len(ratio))], axis=1)
    beta, penalty = np.zeros(2), np.diag([RIDGE, 0.0])
    loss = lambda b: weight @ np.logaddexp(0, np.where(good, -1, 1) * (x @ b)) + RIDGE / 2 * b[0] ** 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope_of = x.T @ (weight * (p - good)) + penalty @ beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(bend, slope_of), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope, level = float(beta[0] / scale), float(beta[1] - beta[0] * middle / scale)
    return (slope, level) if slope > 0 else (0.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from all texts of docs (doc_id, text) and labels (doc_id, quality 0 or 1), a bounded sample of each kind.

    A doc_id labelled both ways counts as bad.  Executors count and score the sampled texts whole; the driver gets a
    number per bucket, and one for each of at most 2 * SAMPLE_ROWS rows.
    """
    marked = written(labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")), "marked")
    sizes = {q: marked.filter(F.col("quality") == q).count() for q in (0, 1)}
    few = [least_hashes(marked.filter(F.col("quality") == q), SAMPLE_ROWS, n) for q, n in sizes.items()]
    few = written(few[0].unionByName(few[1]), "few")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").join(F.broadcast(few), "doc_id")
    raw = corpus_counts(docs)
    target = corpus_counts(rows.filter("quality = 1"))
    if not target.any():
        return Model(np.zeros(BUCKETS))
    model = Model(log_ratio(target, raw))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rated = computed(rows, "text", ["doc_id", "quality"], "ratio double", lambda: lambda texts: (shipped.value.mean_ratio(texts),))
    rated = written(rated, "rated").orderBy("doc_id", "ratio", "quality").limit(2 * SAMPLE_ROWS).collect()
    ratio, good = np.array([r["ratio"] for r in rated]), np.array([r["quality"] == 1 for r in rated], bool)
    weight = np.where(good, sizes[1] / max(good.sum(), 1), sizes[0] / max((~good).sum(), 1))
    return Model(model.ratio, *calibrate(ratio, good, weight), sizes[1] / max(sum(sizes.values()), 1))


def kth_largest(rows: DataFrame, column: str, k: int, most: int = 4_096) -> float:
    """The k-th largest value of a column, from counts of ever narrower bins; the driver gets at most `most` values."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    while n > most and low < high:
        width = (high - low) / most
        inside = rows.filter((F.col(column) >= low) & (F.col(column) <= high))
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(most - 1)).cast("int")
        bins = inside.groupBy(at.alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()
        for _, n, low, high in sorted(bins, reverse=True):  # noqa: B007
            if k <= n:
                break
            k -= n
    if low == high:
        return low
    values = rows.filter((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()
    return sorted((v for v, in values), reverse=True)[k - 1]


def gumbel(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A standard Gumbel variate that depends on the seed, the id and the text only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def scored(docs: DataFrame, model: Model, keep: list[str], seed: int = SEED) -> DataFrame:
    """keep, then quality_log_ratio, quality_log_weight and quality_key (log weight plus Gumbel noise; alike for equal rows)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    noisy = docs.withColumn("quality_noise", gumbel(F.col("doc_id"), present(F.col("text")), seed))
    rows = computed(noisy, "text", [*keep, "quality_noise"], "quality_log_ratio double", lambda: lambda texts: (shipped.value.mean_ratio(texts),))
    rows = rows.withColumn("quality_log_weight", F.col("quality_log_ratio") * F.lit(model.slope) + F.lit(model.level))
    return rows.withColumn("quality_key", F.col("quality_log_weight") + F.col("quality_noise")).drop("quality_noise")


def shift_of(weight: np.ndarray, n: np.ndarray, share: float, rounds: int = 100) -> float:
    """What to add to log odds learned where a share of rows was good, for n rows of each weight: the corpus's own
    share by expectation and maximisation, kept off 0 and 1."""
    logit = lambda p: np.log(p / (1 - p))
    shift, least = 0.0, 1 / (n.sum() + 1)
    for _ in range(rounds):
        p = (n / (1 + np.exp(-np.clip(weight + shift, -500, 500)))).sum() / n.sum()
        was, shift = shift, float(logit(np.clip(p, least, 1 - least)) - logit(np.clip(share, least, 1 - least)))
        if abs(shift - was) < 1e-6:
            break
    return shift


def cut_of(keys: DataFrame, model: Model, bins: int = 4_096) -> tuple[float, float]:
    """The key from which on documents stay, and the shift of the odds to the corpus's share of good texts.

    The key is the k-th largest (rows with that very key all stay), k being the sum of the probabilities of all rows,
    summed up in bins of the weight; everything stays where nothing was learned.
    """
    if not model.learned:
        return float("-inf"), 0.0
    low, high = keys.agg(F.min("quality_log_weight"), F.max("quality_log_weight")).first()
    if low is None:
        return float("inf"), 0.0
    at = F.floor((F.col("quality_log_weight") - low) / max((high - low) / bins, 1e-9))
    table = keys.groupBy(at.alias("b")).agg(F.count("*"), F.avg("quality_log_weight")).orderBy("b").collect()
    n, weight = np.array([r[1] for r in table], float), np.array([r[2] for r in table])
    shift = shift_of(weight, n, model.share)
    k = round((n / (1 + np.exp(-np.clip(weight + shift, -500, 500)))).sum())
    return (kth_largest(keys, "quality_key", k) if k else float("inf")), shift


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, log_ratio, log_weight, key, kept: one row per row of docs (doc_id, text).

    Null and empty texts have ratio 0, and the odds that go with it.  Rows alike in id and text share a key, so they
    stay or go together; other ties at the cut stay too.  All rows are kept where labels are missing or of one kind.
    Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    model = learn(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = written(scored(slim, model, ["doc_id"], seed), "keys")
    cut, shift = cut_of(keys, model)
    shifted = [(F.col(f"quality_{c}") + F.lit(shift)).alias(c) for c in ("log_weight", "key")]
    return keys.select("doc_id", F.col("quality_log_ratio").alias("log_ratio"), *shifted, (F.col("quality_key") >= F.lit(cut)).alias("kept"))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that resample() keeps, with their columns; keys are computed again rather than joined."""
    model = learn(docs, labels)
    names = docs.columns
    inner = docs.withColumnsRenamed({c: fresh(f"{c}_of_docs", names) for c in names if c.lower().startswith("quality_")})
    keys = written(scored(inner, model, []), "keys")
    cut, _ = cut_of(keys, model)
    kept = scored(inner, model, inner.columns).filter(F.col("quality_key") >= F.lit(cut))
    return kept.select(*[F.col(a).alias(b) for a, b in zip(inner.columns, names, strict=True)])
