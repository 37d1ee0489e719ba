"""The keyed memory state and windowed usage as Structured Streaming jobs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.sources.scratch import new_path

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, whether it is one file or a folder."""
    stream = spark.readStream.schema(EVENTS)
    return stream.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def _upsert(key: tuple, batches, state: GroupState):
    """Fold the writes of one key into (first place, last place, last value, number of writes)."""
    place, last, value, version = state.get if state.exists else (None, None, None, 0)
    for rows in batches:
        rows = rows[rows["event_id"].notna()]  # a write without a place has no order
        if not len(rows):
            continue
        low, high = rows["event_id"].idxmin(), rows["event_id"].idxmax()
        place = int(rows["event_id"][low]) if place is None else min(place, int(rows["event_id"][low]))
        if last is None or rows["event_id"][high] > last:
            written = rows["value"][high]
            last, value = int(rows["event_id"][high]), None if pd.isna(written) else float(written)
        version += len(rows)
    if place is None:
        return
    state.update((place, last, value, version))
    yield pd.DataFrame({"user_id": [key[0]], "place": [place], "value": pd.Series([value], dtype="object"), "version": [version]})


def upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the upsert over all events that are there, and return the state it ends with.

    Each micro-batch writes the keys that it changed under its own number, so that a batch that is
    run again after a failure replaces its own rows; the newest version of a key is the state.
    """
    out, checkpoint = new_path(spark, "state"), new_path(spark, "state-checkpoint")
    schema = "user_id long, place long, value double, version long"
    changes = read_events(spark, sf_dir).groupBy("user_id").applyInPandasWithState(_upsert, schema, "place long, last long, value double, version long", "update", GroupStateTimeout.NoTimeout)
    write = changes.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
    write.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}")).start().awaitTermination()
    newest = Window.partitionBy("user_id").orderBy(F.col("version").desc())
    state = spark.read.schema(f"{schema}, batch int").parquet(out)
    return state.withColumn("r", F.row_number().over(newest)).where("r = 1").drop("r", "batch")


def usage_windows(spark: SparkSession, sf_dir: str, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Events and value by type in windows of ``width`` that the watermark has closed."""
    out, checkpoint = new_path(spark, "windows"), new_path(spark, "windows-checkpoint")
    windows = read_events(spark, sf_dir).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    rows = windows.select(F.unix_timestamp("window.start").alias("window_start"), "event_type", "events", "total")
    rows.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema("window_start long, event_type string, events long, total double").parquet(out).withColumn("total", F.round("total", 4))
