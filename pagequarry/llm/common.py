"""Helpers the training-data operators share: written tables, joins that stand hot keys, whole groups."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..runtime import discard, shared_dir, whole_groups, written

__all__ = ["blocked", "computed", "discard", "fresh", "join_classes", "join_salted", "least_hashes", "present", "shared_dir", "shelved", "small_batches", "table", "whole_groups", "written"]

#: Bytes of an Arrow batch (one row at least), so that batches of very long texts still fit a worker.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES: one value for all operators, as frames are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def computed(df: DataFrame, column: str, keep: Sequence[str], ddl: str, setup: Callable[[], Callable[[list], Sequence]]) -> DataFrame:
    """The columns keep of df as they are, followed by those of ddl.

    Each task calls setup once and what it returns on the values of column, a batch at a time (None for null).
    Values that are kept pass through Arrow untouched, so large ids and nulls stay exact.
    """
    small_batches(df.sparkSession)
    extra = StructType.fromDDL(ddl)
    kept = [f for f in df.schema.fields if f.name in keep]
    names = [*(f.name for f in kept), *extra.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        types = [to_arrow_type(f.dataType) for f in extra.fields]
        for batch in batches:
            made = work(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *map(pa.array, made, types)], names=names)

    used = df.select(*dict.fromkeys([*(f.name for f in kept), column]))
    return used.mapInArrow(run, StructType([*kept, *extra.fields]))


def shelved(rows: Iterable[Row], types: dict[str, type]) -> tuple[list[Row], dict[str, list[np.ndarray]]]:
    """Rows without the binary columns of types, and those columns as arrays in mapped temporary files of the driver."""
    files, sizes, rest = {c: tempfile.TemporaryFile() for c in types}, {c: [] for c in types}, []
    for r in rows:
        rest.append(Row(**{c: v for c, v in r.asDict().items() if c not in types}))
        for c, file in files.items():
            file.write(r[c])
            sizes[c].append(len(r[c]) // np.dtype(types[c]).itemsize)
    out = {}
    for c, file in files.items():
        file.flush()
        whole = np.memmap(file, types[c], "r").view(np.ndarray) if sum(sizes[c]) else np.zeros(0, types[c])
        out[c] = np.split(whole, np.cumsum(sizes[c])[:-1])[: len(rest)]
    return rest, out


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with one small row per key of their own; size is the number of rows that have the key.

    Keys that hold over a 500th of all rows (500 of them at most, so they may be broadcast) never shuffle
    their rows; the rest meet in a shuffle join.  Class rows that hold whole texts belong in join_salted.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    bar = max(total // 500, 100)
    hot, cold = (classes.filter(c).drop(size) for c in (F.col(size) > bar, F.col(size) <= bar))
    if total <= bar:
        return rows.join(cold, key, how)
    spread = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(spread.join(cold, key, how))


def join_salted(rows: DataFrame, classes: DataFrame, key: str, size: str) -> DataFrame:
    """join_classes for class rows of any width: those of hot keys are dealt out in copies, only keys are broadcast.

    A key over a 500th of all rows gets as many copies of its class row as it has 500ths, 1,000 over all at most,
    and each of its rows goes to one of them by a hash of its other columns.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    bar = max(total // 500, 100)
    parts, salt = (fresh(c, [*rows.columns, *classes.columns]) for c in ("salt_parts", "salt"))
    hot = classes.filter(F.col(size) > bar).select(key, F.ceil(F.col(size) / bar).cast("int").alias(parts))
    each = F.xxhash64(*[c for c in rows.columns if c != key])
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(salt, F.coalesce(F.pmod(each, F.col(parts)), F.lit(0)).cast("int")).drop(parts)
    copies = F.when(F.col(size) > bar, F.ceil(F.col(size) / bar)).otherwise(1).cast("int")
    spread = classes.withColumn(salt, F.explode(F.sequence(F.lit(0), copies - 1))).drop(size)
    return dealt.join(spread, [key, salt]).drop(salt)


def least_hashes(rows: DataFrame, quota: int, n: int, key: str = "doc_id") -> DataFrame:
    """The quota rows of n with the least hashes of key; a cut on the hash leaves few for the one task that sorts."""
    hashed = rows.withColumn("least_hash", F.xxhash64(key))
    if 2 * quota < n:
        hashed = hashed.filter(F.col("least_hash") <= F.lit(-(2**63) + (2**64 * 2 * quota) // n))
    return hashed.orderBy("least_hash", key).limit(quota).drop("least_hash")


def blocked(rows: DataFrame, keys: list[str], row_id: str, chunk: int) -> DataFrame:
    """Deal each group of two or more rows into blocks of at most about 2 * chunk rows.

    A group of up to chunk rows is one block.  A larger one is cut into c parts by a hash of the row id, and
    every pair of parts is a block (columns left_part < right_part, part), so that any two rows of a group
    stand together in some block and no task holds an unbounded group.
    """
    keyed = rows.withColumn("group_key", F.xxhash64(*keys)).drop(*keys)
    sizes = written(keyed.groupBy("group_key").agg(F.count("*").alias("group_rows")).filter("group_rows > 1"), "sizes")
    met = join_classes(keyed, sizes.withColumn("n", F.col("group_rows")), "group_key", "n")
    parts = F.ceil(F.col("group_rows") / chunk).cast("int")
    part = F.when(parts > 1, F.pmod(F.xxhash64(F.lit(11), row_id), parts).cast("int")).otherwise(0)
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))))
    met = met.withColumn("parts", parts).withColumn("part", part).withColumn("other_part", other)
    return met.select(
        "*", F.least("part", "other_part").alias("left_part"), F.greatest("part", "other_part").alias("right_part")
    ).drop("other_part", "group_rows")


def fresh(name: str, columns: Sequence[str]) -> str:
    """name, or name with underscores added until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def present(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))
