"""File sources and sinks: paged documents, dictionaries, script sheets, layout JSON, the text cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ..functions import fixed as X, text as T


#: What a frame of rows that Python makes holds at most, but for its last row.
FRAME_ROWS, FRAME_BYTES = 10_000, 4 << 20


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, md5, content of each document file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.md5("content").alias("md5"), "content")


def split_pages(documents: DataFrame, splitter: Callable[[bytes, list[int] | None], Iterator[tuple[int, object]]], schema: str, pages: list[int] | None = None) -> DataFrame:
    """Blocks of pages, one document at a time: path, page_num, error, and the block's columns of schema.

    splitter yields (page, blocks) and is told which pages are wanted.  blocks is a list, an exception, or a function
    that returns a list; a page whose function raises, or that is an exception, becomes a row with an error and the
    pages after it go on.  What the splitter itself raises ends its document with an error without a page.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def of_page(path: str, page: int, blocks: object) -> list[dict]:
        try:
            if isinstance(blocks, Exception):
                raise blocks
            return [{"path": path, "page_num": page, **b} for b in (blocks() if callable(blocks) else blocks)]
        except Exception as e:  # a bad page must not stop the others
            return [{"path": path, "page_num": page, "error": f"{type(e).__name__}: {e}"}]

    columns = ["path", "page_num", "error", *names]

    def rows_of(path: str, content: bytes) -> Iterator[dict]:
        try:
            for page, blocks in splitter(content, pages):
                yield from of_page(path, page, blocks)
        except Exception as e:  # a bad document must not stop the others
            yield {"path": path, "error": f"{type(e).__name__}: {e}"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames hold the rows of many small documents, or a part of a large one."""
        frame = lambda rows: pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})
        rows, size = [], 0
        for each in frames:
            for path, content in zip(each["path"], each["content"], strict=True):
                for row in rows_of(path, content):
                    rows.append(row)
                    size += sum(len(v) for v in row.values() if isinstance(v, (str, bytes, bytearray, list)))
                    if len(rows) >= FRAME_ROWS or size >= FRAME_BYTES:
                        yield frame(rows)
                        rows, size = [], 0
        if rows:
            yield frame(rows)

    return documents.select("path", "content").mapInPandas(run, f"path string, page_num int, error string, {schema}")


def split_masks(documents: DataFrame, splitter: Callable[[bytes, list[int] | None], Iterator[tuple[int, object]]], pages: list[int] | None = None) -> DataFrame:
    """path, page_num, error, page_width, page_height, mask of pages whose text is known already: nothing is recognised."""
    return split_pages(documents, splitter, "page_width double, page_height double, mask binary", pages)


def good_and_failed(split: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split.filter("error IS NULL").drop("error"), split.filter("error IS NOT NULL").select("path", "page_num", "error")


def fast_or_deep(pages: DataFrame) -> DataFrame:
    """path_taken: fast for pages whose embedded text is usable, else deep; pages is (images, chars, valid_blocks)."""
    deep = (F.col("images") > 0) & (F.col("chars") < 30) | (F.col("valid_blocks") == 0)
    return pages.withColumn("path_taken", F.when(deep, "deep").otherwise("fast"))


def read_dictionary(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """ord, src, tgt, tier of a JSON object of strings; a missing, broken or other file has no entries."""
    empty = spark.createDataFrame([], "ord int, src string, tgt string, tier string")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return empty
    entries = F.from_json("value", "map<string,string>")
    got = spark.read.text(path, wholetext=True).filter(F.trim("value").startswith("{")).select(F.posexplode(F.map_entries(entries)).alias("ord", "e"))
    return got.select("ord", F.col("e.key").alias("src"), F.col("e.value").alias("tgt"), F.lit(tier).alias("tier"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """ord, src, tgt, tier of a JSON array of objects."""
    entries = F.from_json("value", "array<struct<src:string,tgt:string,lang:string,domain:string>>")
    got = spark.read.text(path, wholetext=True).select(F.posexplode(entries).alias("ord", "e"))
    return got.select("ord", "e.src", "e.tgt", F.lit("glossary").alias("tier"))


def without_runtime_keys(df: DataFrame) -> DataFrame:
    """df without columns and nested fields whose names begin with an underscore."""

    def pruned(c: Column, t: DataType) -> Column:
        if isinstance(t, StructType):
            return F.when(c.isNotNull(), F.struct(*[pruned(c[f.name], f.dataType).alias(f.name) for f in t.fields if not f.name.startswith("_")]))
        if isinstance(t, ArrayType) and isinstance(t.elementType, StructType):
            return F.transform(c, lambda x: pruned(x, t.elementType))
        return c

    return df.select(*[pruned(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if not f.name.startswith("_")])


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages (page_num, ...) in order of their number: each file holds a range of them, sorted; files are in order too."""
    pages.repartitionByRange("page_num").sortWithinPartitions("page_num").write.mode("overwrite").parquet(path)


def write_layout(layout: DataFrame, path: str) -> None:
    without_runtime_keys(layout).write.mode("overwrite").json(path)


def script_rows(blocks: DataFrame) -> DataFrame:
    """The sheet's rows: blocks (page_num, id, raw, translated, bbox) with either text, coordinates to two decimals."""
    some = (T.strip(F.coalesce("raw", F.lit(""))) != "") | (T.strip(F.coalesce("translated", F.lit(""))) != "")
    at = [F.bround(F.coalesce(F.col(f"bbox.{c}").cast("double"), F.lit(0.0)), 2).alias(c) for c in ("x0", "y0", "x1", "y1")]
    names = X.SHEET_COLUMNS
    return blocks.filter(some).select(F.col("page_num").alias(names[0]), F.col("id").alias(names[1]), F.col("raw").alias(names[2]), F.col("translated").alias(names[3]), *at)


def write_script(blocks: DataFrame, path: str) -> None:
    """The sheet as CSV (a spreadsheet's carrier): every field quoted, so that nothing reads as a formula."""
    script_rows(blocks).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """page_num, id, bbox, raw, text of a sheet; columns go by place, so two renamed headings do no harm.

    Rows without a page or id, or with ones that aren't numbers, are passed over; a box short of a corner is null.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    changed = sum(a != b for a, b in zip([*rows.columns, *[""] * 8], X.SHEET_COLUMNS, strict=False))
    if changed > 2:
        raise ValueError(f"not a script sheet: {changed} headings differ")
    return parse_script(rows.toDF(*[f"c{k}" for k in range(len(rows.columns))]))


def parse_script(rows: DataFrame) -> DataFrame:
    """rows: strings c0 to c7 by place."""
    at = [F.col(f"c{k}").try_cast("double") for k in range(4, 8)]
    whole = at[0].isNotNull() & at[1].isNotNull() & at[2].isNotNull() & at[3].isNotNull()
    bbox = F.when(whole, F.struct(*[a.alias(n) for a, n in zip(at, ("x0", "y0", "x1", "y1"), strict=True)]))
    page, id_ = F.col("c0").try_cast("int"), F.col("c1").try_cast("int")
    out = rows.select(page.alias("page_num"), id_.alias("id"), bbox.alias("bbox"), F.coalesce("c2", F.lit("")).alias("raw"), F.coalesce("c3", F.lit("")).alias("text"))
    return out.filter("page_num IS NOT NULL AND id IS NOT NULL")


def write_cache(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """cache_key, cached; a folder that isn't there holds nothing."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], "cache_key string, cached string")
    return spark.read.schema("cache_key string, cached string").parquet(path)
