"""SimHash near-duplicates by a binary trie self-join.

Texts are folded to lower case in ASCII and cut at ASCII white space; each run of three words, repeats included,
is hashed with XXH64 (seed 42) and a fingerprint bit is set if over half of the hashes set it.  Fewer words make
one run; no words give fingerprint zero, which links like any other; null counts as empty.

Distinct fingerprints only are compared.  To put pairs within three bits into one task, the 64 bits are cut into
blocks: two fingerprints that differ in at most three bits agree in all but three blocks, so each fingerprint goes
to one bucket for each choice of the blocks to agree.  Within a bucket a binary trie over the sorted fingerprints
is joined with itself from the top bit down: pairs of nodes descend together, add up their differing bits and are
dropped beyond three.  A task emits a spanning forest of its links; components are then found over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import blocked, computed, fresh, join_classes, small_batches, whole_groups, written
from .graph import connected_components, local_components

WORDS, SEED, MOST_BITS = 3, 42, 3
#: Fingerprints of a part of a bucket, and node pairs that descend at once.
PART_ROWS, FRONTIER = 2_048, 1 << 18


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both times
    if not words:
        return 0
    if len(words) <= WORDS:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(WORDS)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fp (the fingerprint's bits as a long)."""

    def work(texts: list[str | None]) -> tuple:
        return (np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64),)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return computed(slim, "text", ["doc_id"], "fp long", lambda: work)


def masks(n: int, most_bits: int = MOST_BITS) -> list[int]:
    """Masks of the bits to agree, one for each choice of blocks, of about as many bits as log2(n)."""
    blocks = next((b for b in range(most_bits + 1, 12) if 64 * (b - most_bits) // b >= np.log2(max(n, 2)) - 6), 12)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(bits, blocks - most_bits)]


def trie_join(value: np.ndarray, group: np.ndarray, most_bits: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of positions with one group and values at most most_bits apart, values distinct in a group.

    Nodes are ranges of the sorted values.  The frontier holds pairs of nodes at one depth with the bits in which
    their prefixes differ; it descends in slices, the last first, so that its size stays bounded.
    """
    order = np.lexsort((value, group))
    v, g = value[order], group[order]
    cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    lo, hi = cuts[:-1], cuts[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    todo = [(63, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    left, right = [], []
    ones: dict[int, np.ndarray] = {}  # by bit, how many of the first k values have it set
    while todo:
        bit, alo, ahi, blo, bhi, err = todo.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            todo += [(bit, *(x[part] for x in (alo, ahi, blo, bhi, err))) for part in (slice(half), slice(half, None))]
            continue
        if bit < 0:
            left.append(alo)
            right.append(blo)
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        one = ones[bit]
        # within a node the values share all higher bits, so those with this bit set come last
        amid, bmid = ahi - (one[ahi] - one[alo]), bhi - (one[bhi] - one[blo])
        same = alo == blo
        kids = [
            (alo, amid, blo, bmid, err),
            (amid, ahi, bmid, bhi, err),
            (alo, amid, bmid, bhi, err + 1),
            (amid[~same], ahi[~same], blo[~same], bmid[~same], err[~same] + 1),
        ]
        alo, ahi, blo, bhi, err = (np.concatenate(x) for x in zip(*kids, strict=True))
        lone = (alo == blo) & (ahi - alo < 2)
        keep = (err <= most_bits) & (ahi > alo) & (bhi > blo) & ~lone
        if keep.any():
            todo.append((bit - 1, *(x[keep] for x in (alo, ahi, blo, bhi, err))))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def links(distinct: DataFrame, n: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints (fp), n of them, that are within most_bits."""
    spark = distinct.sparkSession
    buckets = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("agreed")) for k, m in enumerate(masks(n, most_bits))]))
    rows = written(distinct.select("fp", buckets.alias("b")).select("fp", "b.choice", "b.agreed"), "buckets")
    dealt = blocked(rows, ["choice", "agreed"], "fp", PART_ROWS)
    keys = ["group_key", "left_part", "right_part"]
    small_batches(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(frames, keys):
            fp = f["fp"].to_numpy()
            a, b = trie_join(fp.view(np.uint64), f.groupby(keys, sort=False).ngroup().to_numpy(), most_bits)
            nodes, at = np.unique(fp, return_inverse=True)
            root = local_components(len(nodes), at[a], at[b])
            linked = np.flatnonzero(root != np.arange(len(nodes)))
            yield pd.DataFrame({"a": nodes[linked], "b": nodes[root[linked]]})

    return dealt.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def labelled(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """rows (doc_id, fp) -> one row per distinct fp: component, component_id, copies."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "classes")
    found = connected_components(links(classes.select("fp"), classes.count(), most_bits)).select(F.col("node").alias("fp"), "component")
    named = classes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes"))
    return written(join_classes(named, written(least, "least"), "component", "classes").drop("first_id"), "labelled")


def components(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per row of docs (doc_id, text).

    component_id is the least doc_id reachable by links, its own included; null ids don't count, and a component
    of null ids has a null component_id.  Repeated rows and ids keep a row each; an empty table gives none.
    """
    rows = written(fingerprints(docs), "fingerprints")
    out = join_classes(rows, labelled(rows, most_bits).drop("component"), "fp", "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs, with their columns, without all but one of each component.

    The least id stays (a null id only where there is no other, then the least text hash); of repeated rows one.
    """
    names = docs.columns
    tag = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))

    def work(texts: list[str | None]) -> tuple:
        return (np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64),)

    rows = written(computed(tag, "text", ["doc_id", "text_hash"], "fp long", lambda: work), "fingerprints")
    member = join_classes(rows, labelled(rows, most_bits).select("fp", "component", "copies"), "fp", "copies")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    stay = written(member.groupBy("component").agg(first).select(row_key(F.col("first.doc_id"), F.col("first.text_hash")).alias("simhash_row")).distinct(), "stay")
    inner = docs.withColumnsRenamed({c: fresh(f"{c}_of_docs", names) for c in names if c.lower().startswith("simhash_")})
    keyed = inner.withColumn("simhash_row", row_key(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    turn = F.row_number().over(Window.partitionBy("simhash_row").orderBy(F.lit(0)))
    kept = keyed.join(stay, "simhash_row").withColumn("simhash_turn", turn).filter("simhash_turn = 1")
    return kept.select(*[F.col(a).alias(b) for a, b in zip(inner.columns, names, strict=True)])


def row_key(doc_id: Column, text_hash: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash.cast("string"))
