"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the tables that are read by frames of :func:`materialize`.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _hadoop(spark: SparkSession, path: str):
    """The file system and the path that Spark takes a folder for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: one without is of the default file system."""
    system, at = _hadoop(spark, path)
    whole = system.makeQualified(at).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session.

    Only a session without that setting whose executors live in the driver's own process
    (``local[...]``, as in tests) gets a new temporary folder; elsewhere it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return qualified(spark, root.rstrip("/"))
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/memloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freeing_shuffles(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage durably (a lost executor loses nothing), gives the planner a real size for
    what follows, and lets Spark drop the shuffle files that led to the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _freeing_shuffles(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _folders[made] = path
    return made


def drop(*made: DataFrame) -> None:
    """Delete the tables behind frames of :func:`materialize`. Nothing may read them, or what is derived from them, any more."""
    for df in made:
        if path := _folders.pop(df, None):
            system, at = _hadoop(df.sparkSession, path)
            system.delete(at, True)


def forget(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application that are still there: at its end, when no result is to be read any more."""
    system, at = _hadoop(spark, f"{shared_root(spark)}/memloom/{spark.sparkContext.applicationId}")
    system.delete(at, True)
    _folders.clear()
