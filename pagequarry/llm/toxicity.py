"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first 4, 5 and 6 bytes.  Filters of
several widths slide over the words; each filter's largest value over the whole text enters a logistic layer.
The first embedding coordinate starts as the log odds of its feature in toxic texts, the others at random; all
parameters are then trained together by Adam on a bounded sample.  Thresholds are set on rows kept out of the
descent, one for each language that langid predicts from the text, so a score depends on the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import langid
from .common import computed, discard, least_hashes, shelved, written
from .tokens import LOWER, NOT_WORD, _power, cut, mix

BUCKET_BITS, DIMENSIONS, FILTERS, WIDTHS, PREFIXES = 15, 8, 8, (1, 2, 3), (4, 5, 6)
#: Labelled rows that are learned from at most; each is read whole.
SAMPLE_ROWS = 6_000
#: Toxic rows of a language from which it gets a threshold of its own.
LEAST_TOXIC = 10


def word_features(text: str | None) -> np.ndarray:
    """Buckets (n words, 1 + prefixes) of a text; a text is hashed in pieces that end between words."""
    pieces = [_features(LOWER[np.frombuffer(p, np.uint8)]) for p in cut((text or "").encode("utf-8", "surrogatepass"))]
    return pieces[0] if len(pieces) == 1 else np.concatenate(pieces)


def _features(data: np.ndarray) -> np.ndarray:
    n = len(data)
    edge = np.diff(np.concatenate(([True], NOT_WORD[data], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for k, least in enumerate((None, *PREFIXES)):
        stop = ends if least is None else np.minimum(ends, starts + least)
        h = mix((sums[stop] - sums[starts]) * inverse[starts] + np.uint64(k + 1))
        out[:, k] = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    return out


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # of each width: (width * DIMENSIONS, FILTERS)
    out: np.ndarray
    bias: float = 0.0
    steps: int = 0
    moments: dict = field(default_factory=dict)

    def pooled(self, feature: np.ndarray, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest value over all places of a text and that place; a text without words has zeros."""
        n, total = len(feature), FILTERS * len(WIDTHS)
        best, place = np.full(total, -np.inf, np.float32), np.zeros(total, np.int64)
        for k in range(0, n, block):
            x = self.embedding[feature[k : k + block + max(WIDTHS) - 1]].sum(axis=1)
            for j, width in enumerate(WIDTHS):
                y = np.zeros((max(len(x) - width + 1, 0), FILTERS), np.float32)
                for i in range(width):
                    y += (x @ self.filters[j][i * DIMENSIONS : (i + 1) * DIMENSIONS])[i : i + len(y)]
                if len(y):
                    at, own = y.argmax(axis=0), slice(j * FILTERS, (j + 1) * FILTERS)
                    top = y[at, np.arange(FILTERS)]
                    more = top > best[own]
                    best[own], place[own] = np.where(more, top, best[own]), np.where(more, at + k, place[own])
        return np.where(np.isfinite(best), np.maximum(best, 0), 0).astype(np.float32), np.where(best > 0, place, -1)

    def logit(self, feature: np.ndarray) -> float:
        return float(self.pooled(feature)[0] @ self.out + self.bias)

    def adam(self, name: str, value: np.ndarray, grad: np.ndarray, rate: float, rows: np.ndarray | None = None) -> None:
        m, v = self.moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= rate * m[at] / (np.sqrt(v[at]) + 1e-6)

    def learn(self, features: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One Adam step on a batch; gradients flow through each filter's best place only."""
        grads = [np.zeros_like(w) for w in self.filters]
        out, bias, ids, each = np.zeros_like(self.out), 0.0, [], []
        for f, y, w in zip(features, label, weight, strict=True):
            h, place = self.pooled(f)
            d = w * (1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -30, 30))) - y)
            out += d * h
            bias += d
            for c in np.flatnonzero(place >= 0):
                j, k = divmod(c, FILTERS)
                words = f[place[c] : place[c] + WIDTHS[j]]
                x = self.embedding[words].sum(axis=1).reshape(-1)
                down = d * self.out[c]
                grads[j][:, k] += down * x
                ids.append(words.reshape(-1))
                each.append(np.repeat((down * self.filters[j][:, k]).reshape(-1, DIMENSIONS), words.shape[1], axis=0))
        n = np.float32(len(features))
        if ids:
            rows, at = np.unique(np.concatenate(ids), return_inverse=True)
            grad = np.zeros((len(rows), DIMENSIONS), np.float32)
            np.add.at(grad, at, np.concatenate(each))
            self.adam("embedding", self.embedding, grad / n, rate, rows)
        for j, g in enumerate(grads):
            self.adam(f"filters{j}", self.filters[j], g / n, rate)
        self.adam("out", self.out, out / n, rate)
        self.bias -= rate * float(bias) / len(features)


def log_odds(features: list[np.ndarray], label: np.ndarray, prior: float = 2.0) -> np.ndarray:
    """Smoothed log ratio of each bucket's share of toxic and of other texts that hold it, scaled to about 1."""
    count = np.zeros((2, 1 << BUCKET_BITS))
    for f, y in zip(features, label, strict=True):
        count[int(y), np.unique(f)] += 1
    rate = max(label.mean(), 1e-3) / max(1 - label.mean(), 1e-3)
    return (np.log((count[1] + prior * rate) / ((count[0] + prior) * rate)) / 4).astype(np.float32)


def fit(features: list[np.ndarray], label: np.ndarray, epochs: int = 3, seed: int = 5) -> tuple[Network, np.ndarray]:
    """A network trained on word_features() and the logits of all texts, those of every fifth from outside the descent."""
    kept = np.arange(len(features)) % 5 == 4
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    embedding = rng.normal(0, 0.02, (size, DIMENSIONS)).astype(np.float32)
    used = np.flatnonzero(~kept)
    embedding[:, 0] = log_odds([features[k] for k in used], label[used])
    filters = [rng.normal(0, 0.1, (w * DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, : FILTERS // 2] += 1
    out = np.full(FILTERS * len(WIDTHS), 0.3, np.float32)
    net = Network(embedding, filters, out, bias=-2.0)
    share = max(label[used].mean(), 1e-3) if len(used) else 0.5
    weight = np.where(label == 1, 0.5 / share, 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 64)):
            if len(batch):
                net.learn([features[k] for k in batch], label[batch], weight[batch], 0.01 * (1 - epoch / epochs))
    return net, np.array([net.logit(f) for f in features])


def threshold(logit: np.ndarray, label: np.ndarray) -> float:
    """The cut with the best balanced accuracy, in the middle of the gap around it."""
    order = np.argsort(logit)
    z, y = logit[order], label[order]
    cuts = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    missed = np.concatenate(([0], np.cumsum(y))) / max(y.sum(), 1)
    false = np.concatenate(([0], np.cumsum(1 - y)))
    loss = missed + 1 - false / max(false[-1], 1)
    gap = np.concatenate(([0], z[1:] - z[:-1], [0]))
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float(cuts[best[gap[best].argmax()]])


@dataclass(frozen=True)
class Model:
    network: Network | None
    language: langid.Model
    cuts: dict[str, float]
    cut: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability-like scores, 0.5 at the threshold of each text's predicted language; 0 if nothing was learned."""
        if self.network is None:
            return np.zeros(len(texts))
        names = self.language.languages
        at = self.language.logits(texts).argmax(axis=1) if names else np.zeros(len(texts), int)
        cut_ = np.array([self.cuts.get(names[a], self.cut) if names else self.cut for a in at])
        z = np.array([self.network.logit(word_features(t)) for t in texts]) - cut_
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def hashed(texts: list[str]) -> tuple:
    """Features of whole texts for the network and for the language model."""
    return [word_features(t).astype(np.uint16).tobytes() for t in texts], *langid.gram_columns(texts)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from documents (doc_id, text, lang) and labels (doc_id, toxic), outside the held-out fold only.

    Executors hash the sampled texts whole; the driver maps their features (8 bytes a word) from a temporary file.
    """
    marked = labels.select("doc_id", "toxic").filter("toxic IN (0, 1)")
    ids = marked.filter(langid.remainder() != langid.HELD_OUT).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = written(ids, "marked")
    few = written(least_hashes(ids, SAMPLE_ROWS, ids.count()), "few")
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang").filter("text IS NOT NULL").join(F.broadcast(few), "doc_id")
    picked = picked.withColumn("text_hash", F.xxhash64("text"))
    rows = written(computed(picked, "text", ["doc_id", "text_hash", "lang", "toxic"], f"words binary, {langid.GRAMS}", lambda: hashed), "hashed")
    order = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash", "lang", "toxic")
    marks, made = shelved(islice(order.toLocalIterator(), SAMPLE_ROWS), {"words": np.uint16, **langid.GRAM_TYPES})
    discard(rows)
    features = [w.reshape(-1, 1 + len(PREFIXES)) for w in made["words"]]
    grams = list(zip(made["gram_ids"], made["gram_shares"], strict=True))
    return train(features, grams, [r["lang"] for r in marks], np.array([r["toxic"] for r in marks], float))


def train(features: list[np.ndarray], grams: list[tuple[np.ndarray, np.ndarray]], langs: list[str | None], label: np.ndarray) -> Model:
    """A model from word_features() and langid.features() of whole texts."""
    known = [k for k, x in enumerate(langs) if x is not None]
    language = langid.train([grams[k] for k in known], [langs[k] for k in known])
    if len(label) < 2 or len(set(label.tolist())) < 2:
        return Model(None, language, {}, 0.0)
    network, z = fit(features, label)
    network.moments = {}
    kept = np.arange(len(features)) % 5 == 4
    if len(set(label[kept].tolist())) < 2:
        kept[:] = True
    at = language.logits_of(grams).argmax(axis=1) if language.languages else np.zeros(len(grams), int)
    every = threshold(z[kept], label[kept])
    cuts = {}
    for k, name in enumerate(language.languages):
        own = kept & (at == k)
        if label[own].sum() >= LEAST_TOXIC and (1 - label[own]).sum() >= LEAST_TOXIC:
            cuts[name] = threshold(z[own], label[own])
    return Model(network, language, cuts, every)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, score, predicted: one row per row of docs, null and empty texts too.

    A score depends on the text alone, so repeated rows and equal texts tie.  A null doc_id counts as held out; columns
    other than doc_id and text are ignored; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = computed(slim, "text", ["doc_id"], "score double", lambda: lambda texts: (shipped.value.scores(texts),))
    return out.select("doc_id", (langid.remainder() == langid.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
