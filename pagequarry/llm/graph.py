"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import discard, join_classes, written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes, by hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def is_stars(link: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every node but the least of its component names that one."""
    ends = link.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(link.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return seen.filter("up > 1 OR up > 0 AND down > 0").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component), component being the smallest node reachable.

    Alternating large-star and small-star steps; each round is written to the shared folder, and the rows of a
    hub don't meet in one task.  Self loops and repeated edges do no harm; rows with a null end are left out; no
    edges give no rows.
    """
    link = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    link = written(link.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "around")
        large = join_classes(both, around, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        below = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "below")
        small = join_classes(large, below, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.unionByName(below.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(link, around, large, below)
        link = new
        if is_stars(link):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = link.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(link.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
