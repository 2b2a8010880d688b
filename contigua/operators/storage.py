"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, on one machine, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/contigua-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that the settled() call of this thread has named and nobody has deleted yet; none are kept outside of one.
_named: ContextVar[dict[str, None] | None] = ContextVar("named", default=None)


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder; nothing is created."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if (scope := _named.get()) is not None:
        scope[path] = None
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if scope := _named.get():
        scope.pop(path, None)


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage and size estimates start anew, and executors can be lost."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a result of written() that nothing reads any more."""
    if path := getattr(df, "written_to", None):
        remove(df.sparkSession, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What make() returns, written; the other folders that were named for it, by this thread, are deleted."""
    outer, scope = _named.get(), {}
    token = _named.set(scope)
    try:
        out = written(make(), what)
        for path in [p for p in scope if p != out.written_to]:
            remove(spark, path)
    finally:
        _named.reset(token)
    if outer is not None:
        outer.update(scope)
    return out
