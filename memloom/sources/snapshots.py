"""Snapshots of memory states: entries and sources of all memories under a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Layout of a snapshot.
SCHEMA = "memory-state.v1"


def save(entries: DataFrame, sources: DataFrame, path: str, version: int) -> None:
    """Write a version; a version that is there is replaced as a whole. It counts once its marker is written, last of all."""
    at = f"{path}/version={version}"
    entries.write.mode("overwrite").parquet(f"{at}/entries")
    sources.write.mode("overwrite").parquet(f"{at}/sources")
    spark = entries.sparkSession
    spark.createDataFrame([(SCHEMA, version)], "schema string, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and sources of a version, by default the newest; an unknown layout raises ValueError."""
    known = spark.read.option("recursiveFileLookup", "true").schema("schema string, version long").parquet(f"{path}/versions")
    found = known.where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.col("version").desc()).first()
    if found is None or found.schema != SCHEMA:
        raise ValueError(f"no snapshot of layout {SCHEMA} here: {path}")
    at = f"{path}/version={found.version}"
    return spark.read.parquet(f"{at}/entries"), spark.read.parquet(f"{at}/sources")
