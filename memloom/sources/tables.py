"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``; only ``columns`` when given."""
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer tasks than there are cores, as one file of one row group has; else as it is.

    For work that costs far more per row than moving the row. Large inputs have more splits than cores and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
