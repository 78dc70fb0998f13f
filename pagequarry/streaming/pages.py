"""Pages as a stream: files arrive, whole pages gather in batches per document, bad rows go aside."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed as X
from ..runtime import new_path

BATCHES = "doc long, page_num long, lines long, batch long"


#: What a micro-batch takes of the files that have come, unless their number is given.
BYTES_AT_ONCE = 64 << 20


def page_stream(spark: SparkSession, path: str, schema: str, name: str | None = None, files_at_once: int | None = None) -> DataFrame:
    """A stream of Parquet files, a bounded share of them in each micro-batch, so that a slow consumer isn't flooded.

    The share is one of bytes: many small files make no more micro-batches than few large ones.  With a name, the stream
    is of the table of that name in path, be it one file or a folder of files.
    """
    limit = ("maxFilesPerTrigger", files_at_once) if files_at_once else ("maxBytesPerTrigger", BYTES_AT_ONCE)
    reader = spark.readStream.schema(schema).option(*limit)
    if not name:
        return reader.parquet(path)
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(table).isDirectory():
        return reader.parquet(f"{path}/{name}")
    return reader.option("pathGlobFilter", name).parquet(path)


def packed(pages: DataFrame, least: int = X.CHUNK_LINES) -> DataFrame:
    """doc, page_num, lines, batch: a document's batch closes once it has `least` lines; state is two numbers a document.

    A document's pages must arrive in order from one micro-batch to the next; within one they are sorted here.
    """

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("page_num")
        of = []
        for n in rows["lines"]:
            of.append(batch)
            held += max(0, int(n))
            if held >= least:
                batch, held = batch + 1, 0
        state.update((batch, held))
        yield pd.DataFrame({"doc": key[0], "page_num": rows["page_num"], "lines": rows["lines"], "batch": of})

    return pages.groupBy("doc").applyInPandasWithState(handle, BATCHES, "batch long, held long", "append", GroupStateTimeout.NoTimeout)


def packed_in_order(pages: DataFrame, least: int = X.CHUNK_LINES) -> DataFrame:
    """packed() for pages that arrive in any order: doc, page_num (from 1, without gaps), lines.

    A page that comes before its turn is held in the state until the pages before it are there, so batches are those
    of the sorted document; the state holds the pages that wait, at most those that are out of order.  A page that
    comes again is passed over.
    """

    def handle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, held, turn, early, early_lines = state.get if state.exists else (0, 0, 1, [], [])
        waiting = dict(zip(early, early_lines, strict=True))
        for f in frames:
            for page, n in zip(f["page_num"].tolist(), f["lines"].tolist(), strict=True):
                if page >= turn:
                    waiting.setdefault(int(page), int(n))
        out = []
        while turn in waiting:
            n = waiting.pop(turn)
            out.append((key[0], turn, n, batch))
            held, turn = held + max(0, n), turn + 1
            if held >= least:
                batch, held = batch + 1, 0
        state.update((batch, held, turn, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["doc", "page_num", "lines", "batch"])

    kept = "batch long, held long, turn long, early array<bigint>, early_lines array<bigint>"
    return pages.groupBy("doc").applyInPandasWithState(handle, BATCHES, kept, "append", GroupStateTimeout.NoTimeout)


def binary_stream(spark: SparkSession, path: str, files_at_once: int = 4) -> DataFrame:
    """A stream of document files (path, content), few of them in each micro-batch; split_pages() works on it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_at_once).load(path).select("path", "content")


def gated(stages: Sequence[tuple[str, Callable[[], DataFrame], str]], paths: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Run streams one after another, each a gate for the next: (name, stream, schema) -> the tables they wrote, by name.

    A stream is built when its turn comes, so it may read what the stages before it have written (paths gets their
    folders); what a stage raises ends the run and the later stages never start.
    """
    done: dict[str, DataFrame] = {}
    paths = {} if paths is None else paths
    for name, stream, schema in stages:
        made = stream()
        paths[name] = new_path(made.sparkSession, name)
        done[name] = drain(made, name, schema, paths[name])
    return done


def drain(stream: DataFrame, name: str, schema: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is, into Parquet files, and return them; with the same paths it goes on where it stopped."""
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], name: str, checkpoint: str | None = None) -> None:
    """Hand each micro-batch to work; what it raises stops the stream and is raised here."""
    where = checkpoint or new_path(stream.sparkSession, f"{name}-checkpoint")
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
