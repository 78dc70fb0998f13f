"""Embedding near-duplicates by E8 lattice hashing.

Equal vectors of one label form a class.  In each table a class's unit vector is projected to eight dimensions
at random, scaled, and decoded to its nearest point of the E8 lattice; it enters that cell and those of the next
nearest lattice points, as long as they are hardly farther (probes).  Classes that share a cell and a label are
compared by their cosine in double precision.  A pair may meet in several cells: it is counted where the hash of
the cell is the least of those they share, so links are counted once and pairs never leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from .common import blocked, join_classes, small_batches, whole_groups, written
from .graph import connected_components, local_components
from .tokens import mix

SIMILARITY = 0.93
#: Hash tables, lattice cells that a vector enters in each at most, and how much farther a probed point may be.
TABLES, CELLS, MARGIN, SCALE, SEED = 6, 3, 0.3, 1.6, 31
#: Classes of a part of a cell.
PART_ROWS = 1_024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [s * np.eye(8)[i] + t * np.eye(8)[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.array([*whole, *(signs[signs.prod(axis=1) > 0] / 2)])


SHORTEST = minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: round, and if the sum is odd the worst one the other way."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    off = x[odd] - f[odd]
    worst = np.abs(off).argmax(axis=1)
    f[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and of D8 moved by one half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def projections(dimensions: int) -> np.ndarray:
    """TABLES random orthonormal maps to eight dimensions, lengths kept on average."""
    rng = np.random.default_rng(SEED)
    width = max(dimensions, 8)
    maps = [np.linalg.qr(rng.normal(size=(width, 8)))[0][:dimensions] * np.sqrt(width / 8) for _ in range(TABLES)]
    return np.stack(maps) * SCALE


def cells(unit: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """Hashes (n, TABLES * CELLS) of the cells that each unit vector enters, 0 where a probe is not worth it."""
    out = np.zeros((len(unit), TABLES, CELLS), np.uint64)
    for t in range(TABLES):
        x = unit @ maps[t]
        home = nearest_e8(x)
        rest = x - home
        far = 2 - 2 * rest @ SHORTEST.T  # how much farther, squared, each neighbour of the home point is
        near = np.argpartition(far, CELLS - 1, axis=1)[:, : CELLS - 1] if CELLS > 1 else np.zeros((len(x), 0), int)
        out[:, t, 0] = _hash(home, t)
        for k in range(CELLS - 1):
            worth = np.take_along_axis(far, near[:, k : k + 1], axis=1)[:, 0] <= MARGIN * 2
            out[:, t, k + 1] = np.where(worth, _hash(home + SHORTEST[near[:, k]], t), 0)
    return out.reshape(len(unit), -1)


def _hash(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(len(points), table + 1, np.uint64)
    for c in (points * 2).astype(np.int64).astype(np.uint64).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return np.maximum(h, np.uint64(1))


def usable() -> Column:
    """Whether a row may link: a label, and a vector that isn't null or zero and has finite components only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    every = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(every, F.lit(False))


def normalised(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component goes first, so that no square under- or overflows."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(units: np.ndarray, shared: np.ndarray, weight: np.ndarray, part: np.ndarray, cell: int, parts: tuple[int, int], count: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one block: for each row the weight of its links counted here, and the pairs (i, j) that link."""
    links = np.zeros(len(units), np.int64)
    cosine = units @ units.T
    a, b = np.nonzero(np.triu(cosine >= similarity, 1))
    if not len(a):
        return links, a, b
    # two rows of one part meet in every block of that part: (0, part) counts them, for part 0 (0, 1)
    low, high = parts
    mine = (part[a] != part[b]) | (count == 1) | ((low == 0) & ((part[a] == high) | (high == 1)))
    a, b = a[mine], b[mine]
    once = np.zeros(len(a), bool)
    for k in range(0, len(a), 2_048):
        x, y = shared[a[k : k + 2_048]], shared[b[k : k + 2_048]]
        both = ((x[:, :, None] == y[:, None, :]).any(axis=2)) & (x != 0)
        once[k : k + 2_048] = np.where(both, x, np.iinfo(np.uint64).max).min(axis=1) == np.uint64(cell)
    np.add.at(links, a[once], weight[b[once]])
    np.add.at(links, b[once], weight[a[once]])
    return links, a, b


def near_duplicates(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept: one row per row.

    Only rows of one label and one length of vector are compared.  Rows with a null label, a null or zero vector,
    or one with a null or non-finite component link with nothing; a null vec_id is never a component's id unless
    it stands alone.  kept: vec_id = component_id (both null counts as equal).  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.elementType
    dtype = np.float32 if isinstance(kind, FloatType) else np.float64
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    name = F.substring(F.sha2(F.concat_ws("|", F.col("label"), F.array_join(F.transform("embedding", lambda x: F.hex(F.xxhash64(x + 0.0))), "")), 256), 1, 32)
    rows = written(base.filter(usable()).withColumn("class", name).select("vec_id", "class", "label", "embedding"), "vectors")
    classes = written(rows.groupBy("class").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")), "classes")
    small_batches(spark)

    def enter(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maps: dict[int, np.ndarray] = {}
        for f in frames:
            for d, g in f.groupby(f["embedding"].str.len()):
                raw = np.stack(g["embedding"].to_list())
                if d not in maps:
                    maps[d] = projections(d)
                own = cells(normalised(raw), maps[d])
                yield pd.DataFrame({"class": g["class"], "copies": g["copies"], "label": g["label"], "size": d, "vector": [v.astype(dtype).tobytes() for v in raw], "cells": list(own.view(np.int64))})

    schema = "class string, copies long, label string, size int, vector binary, cells array<bigint>"
    prepared = written(classes.select("class", "copies", "label", "embedding").mapInPandas(enter, schema), "prepared")
    entered = written(prepared.select("class", "label", "size", F.explode("cells").alias("cell")).filter("cell <> 0"), "entered")
    dealt = blocked(entered.withColumn("the_cell", F.col("cell")), ["label", "size", "cell"], "class", PART_ROWS)
    keys = ["group_key", "left_part", "right_part"]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys):
            out = []
            for key, g in f.groupby(keys, sort=False):
                names = g["class"].to_numpy()
                units = normalised(np.frombuffer(b"".join(g["vector"]), dtype).reshape(len(g), -1))
                shared = np.stack(g["cells"].to_list()).astype(np.int64).view(np.uint64)
                cell = g["the_cell"].iloc[0].astype(np.int64).view(np.uint64)
                links, a, b = compare(units, shared, g["copies"].to_numpy(), g["part"].to_numpy(), cell, (key[1], key[2]), int(g["parts"].iloc[0]), similarity)
                if len(a):
                    root = local_components(len(g), a, b)
                    on = np.unique(np.concatenate((a, b)))
                    out.append(pd.DataFrame({"class": names[on], "links": links[on], "near": names[root[on]]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    slim = dealt.select(*keys, "class", "part", "parts", "the_cell")  # vectors join what is left after lone entries went
    found = slim.join(prepared.select("class", "copies", "vector", "cells"), "class").repartition(*keys).sortWithinPartitions(*keys)
    found = written(found.mapInPandas(verify, "class string, links long, near string"), "found")
    comps = connected_components(found.select(F.col("class").alias("a"), F.col("near").alias("b"))).select(F.col("node").alias("class"), "component")
    # a class has rows of many blocks: summed up by some of their neighbours first, so that no task gets all of one
    some = found.groupBy("class", F.pmod(F.xxhash64("near", "links"), F.lit(16)).alias("deal")).agg(F.sum("links").alias("links"))
    linked = some.groupBy("class").agg(F.sum("links").alias("links"))
    named = classes.select("class", "first_id", "copies").join(linked, "class", "left").join(comps, "class", "left")
    named = written(named.withColumn("component", F.coalesce("component", "class")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1), "named")
    least = written(named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes")), "least")
    labelled = written(join_classes(named, least, "component", "classes"), "labelled")
    out = join_classes(rows.select("vec_id", "class"), labelled.select("class", "n_links", "component_id", "copies"), "class", "copies")
    lone = base.filter(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = out.select("vec_id", "n_links", "component_id").unionByName(lone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

