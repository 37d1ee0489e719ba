"""Memories as streams: entries and sources are upserted as writes arrive, and the state of any batch can be read.

State is keyed by memory and entry (or source), not by memory, so that a memory of any size spreads over tasks, and kept by Spark's
own streaming aggregates: the first place, and what was written at the last place. These don't depend on the order of arrival, and
rows that arrive again change nothing.

Each micro-batch writes the keys that it changed under its own number; a batch that is run again after a failure replaces its own rows.
The state after batch n has for each key the row of its last batch up to n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.state import entry_key

TURNS = "conv_id long, turn long, role string, text string"
#: Columns of a change: an entry (kind ``entry``) or a source.
CHANGES = "memory long, kind string, key string, first long, last long, m string, src array<string>, version long"


def read_turns(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Conversations as a stream of files, some at once if ``files`` is given."""
    stream = spark.readStream.schema(TURNS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(folder)


def changes(writes: DataFrame) -> DataFrame:
    """The upserted rows of a stream (or table) of ``writes``: memory, version, place, m, src, source_id, text.

    A write brings a statement (m, not blank, with sources src) or the text of a source (source_id), or both.
    """
    src = F.array_sort(F.coalesce("src", F.array().cast("array<string>")))
    m = F.regexp_replace("m", "^\\s+|\\s+$", "")
    entry = F.when(F.length(m) > 0, F.struct(F.lit("entry").alias("kind"), entry_key(m, src).alias("key"), m.alias("m"), src.alias("src")))
    source = F.when(F.col("source_id").isNotNull(), F.struct(F.lit("source").alias("kind"), F.col("source_id").alias("key"), F.col("text").alias("m"), F.lit(None).cast("array<string>").alias("src")))
    rows = writes.select("memory", "version", "place", F.explode(F.filter(F.array(entry, source), lambda x: x.isNotNull())).alias("x")).select("memory", "version", "place", "x.*")
    grouped = rows.groupBy("memory", "kind", "key").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.max_by(F.struct("m", "src", "version"), "place").alias("row"))
    return grouped.select("memory", "kind", "key", "first", "last", "row.*")


def run(writes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Apply all writes that are there, and end. Run again with the same folders it goes on where it stopped."""
    stream = changes(writes).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}")).start()


def rows_at(spark: SparkSession, out: str, batch: int | None = None) -> DataFrame:
    """The state after a batch, by default the last: one row per key, as one aggregate of the changes."""
    log = spark.read.schema(f"{CHANGES}, batch long").parquet(out)
    log = log if batch is None else log.where(F.col("batch") <= batch)
    fields = ["first", "last", "m", "src", "version"]
    last = log.groupBy("memory", "kind", "key").agg(F.max_by(F.struct(*fields), "batch").alias("row"))
    return last.select("memory", "kind", "key", "row.*")


def entries_of(rows: DataFrame) -> DataFrame:
    """``memory, entry, m, src, version``, entries numbered from 0 in order of their first place."""
    place = F.row_number().over(Window.partitionBy("memory").orderBy("first")) - 1
    return rows.where("kind = 'entry'").select("memory", place.cast("long").alias("entry"), "m", "src", "version")


def sources_of(rows: DataFrame) -> DataFrame:
    """``memory, source_id, text``."""
    return rows.where("kind = 'source'").select("memory", F.col("key").alias("source_id"), F.col("m").alias("text"))


def deduplicated(items: DataFrame, late: str) -> DataFrame:
    """A stream of block items without replays that arrive up to ``late`` after the first: items are the same by memory, block and number."""
    return items.withWatermark("written", late).dropDuplicatesWithinWatermark(["memory", "block", "written", "item"])


def run_log(items: DataFrame, out: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Write each item once to a log as long as replays come within ``late``. What comes later is sorted out by ``updates.first_writes``."""
    stream = deduplicated(items, late).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint)
    return stream.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{out}/batch={number}")).start()
