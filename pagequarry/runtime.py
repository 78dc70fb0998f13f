"""What operators need of the session: the shared folder, tables written in it, whole groups of sorted partitions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir; a temporary one of our own only where driver and executors are one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = _own_dirs.get(sc.applicationId)
        if not root:
            root = _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="pagequarry-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
            sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/pagequarry/{sc.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once in the shared folder and read it back: cuts the lineage and outlives an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in frames:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables this application has written; frames that read them can't be used any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores dealt to all of them; any larger input stays as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of a partition that is sorted by keys, cut so that no group stands in two of them."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if frame.empty:
            continue
        last = frame[keys].iloc[-1]
        ends = (frame[keys] == last).all(axis=1).to_numpy().argmax()
        if ends == 0 and held and (held[-1][keys].iloc[-1] == last).all():
            held.append(frame)
            continue
        done = pd.concat([*held, frame.iloc[:ends]], ignore_index=True)
        if len(done):
            yield done
        held = [frame.iloc[ends:]]
    if held:
        yield pd.concat(held, ignore_index=True)
