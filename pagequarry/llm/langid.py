"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are the byte trigrams of its letters (ASCII folded, everything else in ASCII read as blanks); its
vector is the mean of their embeddings.  Embeddings and softmax are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows; every text is then scored whole.  Probabilities are calibrated by a
temperature on rows kept out of the training, and a rejection bar is set on the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import computed, discard, shelved, written
from .tokens import NOT_LETTER, gram_index, gram_scores, packed

#: Rows a model is fitted on, dealt to languages by their shares, and those that each language has at least if there
#: are so many (on top of the others); each is read whole.  The folds of row ids.
SAMPLE_ROWS, LEAST_ROWS, FOLDS, HELD_OUT = 4_000, 100, 5, 0
BUCKET_BITS, DIMENSIONS, GRAM = 14, 16, 3
UNKNOWN, ACCURACY = "und", 0.99


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # logits that each bucket adds
    bias: np.ndarray
    heat: float
    bar: float

    def logits(self, texts: list[str | None]) -> np.ndarray:
        sums, n = gram_scores(texts, self.table, GRAM, NOT_LETTER, True)
        return (sums / np.maximum(n, 1)[:, None] + self.bias) / self.heat

    def logits_of(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """logits() from features()."""
        sums = np.array([share @ self.table[ids] for ids, share in rows]).reshape(len(rows), len(self.bias))
        return (sums + self.bias) / self.heat

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        return softmax(self.logits(texts))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text's trigrams and the share of each."""
    n = np.zeros(1 << BUCKET_BITS, np.int64)
    for _, blobs in packed([text]):
        n += np.bincount(gram_index(blobs, GRAM, NOT_LETTER, True, np.uint64(64 - BUCKET_BITS))[1], minlength=len(n))
    ids = np.flatnonzero(n)
    return ids.astype(np.uint16), n[ids] / max(1, n.sum())


#: features() as columns of a table, and their types.
GRAMS, GRAM_TYPES = "gram_ids binary, gram_shares binary", {"gram_ids": np.uint16, "gram_shares": np.float64}


def gram_columns(texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
    each = [features(t) for t in texts]
    return [ids.tobytes() for ids, _ in each], [share.tobytes() for _, share in each]


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 6, rate: float = 20.0, seed: int = 7) -> Model:
    """Fit a model on features() of texts; every tenth row sets the temperature and the bar.  One language or none needs no descent."""
    languages = tuple(sorted(set(langs)))
    rng = np.random.default_rng(seed)
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weight, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    label = np.array([languages.index(x) for x in langs], np.int64)
    kept = np.arange(len(rows)) % 10 == 9 if len(rows) >= 100 else np.zeros(len(rows), bool)
    if len(languages) > 1:
        fit = np.flatnonzero(~kept)
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs)
            for k in rng.permutation(fit):
                ids, share = rows[k]
                x = share @ embedding[ids]
                p = softmax((x @ weight + bias)[None])[0]
                p[label[k]] -= 1
                down = weight @ p
                weight -= step * 0.01 * np.outer(x, p)
                bias -= step * 0.001 * p
                embedding[ids] -= step * share[:, None] * down
    model = Model(languages, embedding @ weight, bias, 1.0, 0.0)
    check = np.flatnonzero(kept) if kept.any() else np.arange(len(rows))
    if len(languages) < 2 or not len(check):
        return model
    z = model.logits_of([rows[k] for k in check])
    loss = lambda heat: -np.log(softmax(z / heat)[np.arange(len(check)), label[check]] + 1e-12).mean()
    heat = best_heat(loss)
    p = softmax(z / heat)
    right, best = p.argmax(axis=1) == label[check], p.max(axis=1)
    bars = [b for b in np.linspace(1 / len(languages), 0.95, 30) if (best >= b).any() and right[best >= b].mean() >= ACCURACY]
    return Model(languages, model.table, bias, heat, float(bars[0]) if bars else 1.0)


def best_heat(loss: Callable[[float], float], low: float = 1 / 16, high: float = 16.0) -> float:
    """The temperature of the least loss, which has one low point, by golden sections of its logarithm."""
    a, b, part = np.log(low), np.log(high), (5**0.5 - 1) / 2
    for _ in range(40):
        x, y = b - part * (b - a), a + part * (b - a)
        a, b = (a, y) if loss(float(np.exp(x))) <= loss(float(np.exp(y))) else (x, b)
    return float(np.exp((a + b) / 2))


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of an id as text, modulo FOLDS; a null id counts as held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % FOLDS, F.lit(HELD_OUT))


def sample(docs: DataFrame, label: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[object]]:
    """features() of whole texts and labels of a bounded sample per label outside the held-out fold, by a hash of the id."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").isNotNull() & (remainder() != HELD_OUT))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total, quotas = sum(sizes.values()), []
    for name, n in sizes.items():
        quota = min(n, max(LEAST_ROWS, -(-SAMPLE_ROWS * n // total)))
        # twice as many hashes as needed, so that few rows meet in a label's task
        quotas.append((name, quota, 2**63 - 1 if 2 * quota >= n else -(2**63) + (2**64 * 2 * quota) // n))
    few = F.broadcast(spark.createDataFrame(quotas, "label string, quota long, most_hash long"))
    picked = rows.withColumn("id_hash", F.xxhash64("doc_id")).join(few, "label").filter("id_hash <= most_hash")
    picked = picked.withColumn("text_hash", F.xxhash64("text"))
    keep = ["doc_id", "label", "quota", "id_hash", "text_hash"]
    hashed = written(computed(picked, "text", keep, GRAMS, lambda: gram_columns), "hashed")
    place = F.row_number().over(Window.partitionBy("label").orderBy("id_hash", "doc_id", "text_hash"))
    chosen = hashed.withColumn("place", place).filter("place <= quota").orderBy("doc_id", "text_hash", "label")
    marks, made = shelved(chosen.toLocalIterator(), GRAM_TYPES)
    discard(hashed)
    return list(zip(made["gram_ids"], made["gram_shares"], strict=True)), [r["label"] for r in marks]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, lang_pred, score, rejected: one row per row of docs.

    Null texts and texts without a letter are `und` with score 0 and rejected, as is every text where no language
    was learned; other texts get the likeliest language (the first by name of equals) and its probability, rejected
    below the model's bar.  Equal texts get equal rows; columns other than doc_id and text are ignored; an empty table
    gives no rows.
    """

    def work(texts: list[str | None]) -> tuple:
        p = model.probabilities(texts) if model.languages else np.zeros((len(texts), 1))
        best, score = p.argmax(axis=1), p.max(axis=1)
        known = np.array([bool(model.languages) and has_letter(t) for t in texts], bool)
        lang = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        score = np.where(known, np.clip(score, 0, 1), 0.0)
        return lang, score, (~known | (score < model.bar))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = computed(slim, "text", ["doc_id"], "lang_pred string, score double, rejected boolean", lambda: work)
    return out.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")


def learn(docs: DataFrame) -> Model:
    """A model from (doc_id, text, lang) rows outside the held-out fold."""
    return train(*sample(docs, "lang"))

