"""Batches of whole pages, slices, retries, metrics and progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed as X



def _batches(pages: DataFrame, most: int, before: bool) -> DataFrame:
    """doc, page_num, lines, batch: one pass over each document's pages in order.

    The pages stream by, sorted, with two numbers held for the document at hand, so a document may have any number of
    pages.  Null documents are one of their own, null lines count as none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, held, some = None, 0, 0, False
        for f in frames:
            of = []
            for key, n in zip(f["doc_key"].tolist(), f["counted"].tolist(), strict=True):
                if key != now:
                    now, batch, held, some = key, 0, 0, False
                if before and some and held + n > most:
                    batch, held = batch + 1, 0
                of.append(batch)
                held, some = held + (n if before else max(n, 0)), True
                if not before and held >= most:
                    batch, held = batch + 1, 0
            f["batch"] = of
            yield f[["doc_key", "page_num", "counted", "batch"]]

    key = F.coalesce(F.col("doc").cast("string"), F.lit(""))
    rows = pages.select(key.alias("doc_key"), "page_num", F.coalesce(F.col("lines").cast("long"), F.lit(0)).alias("counted"))
    page = pages.schema["page_num"].dataType.simpleString()
    done = rows.repartition("doc_key").sortWithinPartitions("doc_key", "page_num", "counted").mapInPandas(run, f"doc_key string, page_num {page}, counted long, batch long")
    doc = F.when(F.col("doc_key") != "", F.col("doc_key")).cast(pages.schema["doc"].dataType)
    return done.select(doc.alias("doc"), "page_num", F.col("counted").alias("lines"), "batch")


def pack_before(pages: DataFrame, most: int = X.CHUNK_LINES) -> DataFrame:
    """Close a batch that has pages when the next page would take it over `most` lines; a larger page stands alone."""
    return _batches(pages, most, before=True)


def pack_after(pages: DataFrame, least: int = X.CHUNK_LINES) -> DataFrame:
    """Close a batch once it has `least` lines or more."""
    return _batches(pages, least, before=False)


def slices(rows: DataFrame, within: str, order: list[str], size: int = X.CHUNK_LINES) -> DataFrame:
    """slice: rows of a group in order, size at a time."""
    place = F.row_number().over(Window.partitionBy(within).orderBy(*order))
    return rows.withColumn("slice", F.floor((place - 1) / size).cast("long"))


def halves(batches: DataFrame, smallest: int = X.CHUNK_LINES) -> DataFrame:
    """Failed batches (batch, lines) cut in two, the larger half first; those of `smallest` lines or fewer go line by line."""
    first = F.ceil(F.col("lines") / 2)
    parts = F.when(F.col("lines") > smallest, F.array(first, F.col("lines") - first))
    return batches.select("batch", F.posexplode(F.coalesce(parts.cast("array<bigint>"), F.array_repeat(F.lit(1).cast("long"), F.col("lines").cast("int")))).alias("part", "part_lines"))


def stage_stats(calls: DataFrame) -> DataFrame:
    """tag, calls, seconds, completion_tokens, failed; seconds are rounded once, at the end."""
    return calls.groupBy("tag").agg(
        F.count("*").alias("calls"), F.round(F.sum("seconds"), 2).alias("seconds"), F.sum("tokens").alias("completion_tokens"),
        F.sum((~F.col("ok")).cast("long")).alias("failed"),
    )


def merge_stats(parts: DataFrame) -> DataFrame:
    """Sums of partial stats by tag."""
    return parts.groupBy("tag").agg(
        F.sum("calls").alias("calls"), F.round(F.sum("seconds"), 2).alias("seconds"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("failed").alias("failed"),
    )


def engine_counts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(F.coalesce("translation_engine", F.lit("Unknown")).alias("engine")).agg(F.count("*").alias("n_blocks"))


def merge_engine_counts(parts: DataFrame) -> DataFrame:
    """engine, n_blocks of partial counts (engine, n_blocks)."""
    return parts.groupBy(F.coalesce("engine", F.lit("Unknown")).alias("engine")).agg(F.sum("n_blocks").alias("n_blocks"))


def throughput(batches: DataFrame) -> DataFrame:
    """Averages over batches (chars, seconds): each batch counts alike, as characters a second."""
    return batches.agg(
        F.avg(F.round(F.col("chars") / F.greatest(F.lit(0.01), "seconds"), 2)).alias("chars_per_sec"), F.lit(100.0).alias("acceptance_rate"),
        F.avg(F.round(F.col("seconds") * 1000, 2)).alias("latency_ms"), F.sum("chars").alias("chars"),
    )


def progress(extracted: Column, translated: Column, rendered: Column, total: Column, start: int = 5, shares: tuple[int, int, int] = (10, 30, 45)) -> Column:
    """Percent done; (15, (15, 35, 30)) are the shares of the other front end."""
    part = lambda share, done: F.floor(F.lit(float(share)) * done / F.greatest(F.lit(1), total))
    return (F.lit(start) + part(shares[0], extracted) + part(shares[1], translated) + part(shares[2], rendered)).cast("long")
