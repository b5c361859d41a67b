"""Scratch tables: what is computed once is written to a folder that all executors share, and read again from there.

Any executor can read such a table after another is lost. Tables of a ``workspace`` go when it ends, others when their
reader is done with them (``done_with``) or else when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names.

    Only in local mode, where the driver is the one executor, that setting may be missing.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/touchline-scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what this package wrote at a scratch path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def removed_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path when the driver ends, if Spark still answers then."""

    def run() -> None:
        with contextlib.suppress(Exception):
            removed(spark, path)

    atexit.register(run)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """Shuffle files of each query that runs inside go when that query ends."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class _Open(threading.local):
    """The open workspaces of a thread, the innermost last."""

    def __init__(self):
        self.paths: list[list[str]] = []


_OPEN = _Open()


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """Tables that ``written`` makes inside, in this thread, go at the end, but for those that are kept."""
    _OPEN.paths.append([])
    try:
        yield
    finally:
        for path in _OPEN.paths.pop():
            removed(spark, path)


def written(spark: SparkSession, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: computed once, with its lineage cut."""
    path = scratch(spark, name)
    if _OPEN.paths and not keep:
        _OPEN.paths[-1].append(path)
    else:
        removed_at_exit(spark, path)
    with tidy_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def tasks_for(spark: SparkSession, path: str, mb: float = 8) -> int:
    """Over how many tasks what is read from ``path`` is to be dealt, so that a task's share doesn't grow with the table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / (mb * 1e6)))


def done_with(df: DataFrame) -> None:
    """Deletes a table of ``written`` before its workspace ends: nothing reads it any more."""
    removed(df.sparkSession, df.scratch_path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a scratch table."""
    return written(df.sparkSession, df, name)
