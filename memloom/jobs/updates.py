"""Write blocks and streamed memories: a conversation is a memory, two of its turns are a block; the second turn of a role in a stretch contradicts the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.jobs.persistent import _ENTRIES, write_columns
from memloom.operators import updates
from memloom.sources.scratch import new_path
from memloom.sources.tables import table
from memloom.streaming import memory

ITEM_COLUMNS = {
    "memory": "conv_id",
    "architecture": "element_at(array('Flat', 'Graph'), int(conv_id % 2 + 1))",
    "ids": "array_sort(array(string(turn div 2 * 2 % 3), string((turn div 2 * 2 + 1) % 3)))",
    "written": "timestamp_seconds(1700000000 + turn div 2 * 60 + conv_id)",
    "item": "turn % 2",
    "m": "trim(text)",
    "src": "array(string(turn % 5))",
    "entity": "role",
    "moment": "if(turn % 7 = 6, NULL, turn div 4)",
}


def block_items(turns: DataFrame) -> DataFrame:
    """Turns as items of blocks; works on a table and on a stream."""
    rows = turns.select(*(F.expr(sql).alias(name) for name, sql in ITEM_COLUMNS.items()))
    return rows.withColumn("block", updates.block_digest(F.col("architecture"), F.col("ids"), F.lit("v1"))).drop("architecture", "ids")


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items, those of every third conversation twice."""
    items = block_items(table(spark, sf_dir, "conversations"))
    return items.unionByName(items.where("memory % 3 = 0"))


def update_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every memory after all blocks, with their conflicts."""
    out = updates.with_conflicts(updates.updated_entries(_replayed(spark, sf_dir)))
    return out.select("memory", "entry", "m", F.array_join("src", ",").alias("src"), "entity", "moment", F.unix_timestamp("written").alias("written"), "conflict", "current")


def update_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a read sees of them."""
    out = updates.readable(updates.with_conflicts(updates.updated_entries(_replayed(spark, sf_dir))))
    return out.select("memory", "entry", "m", F.array_join("src", ",").alias("src"))


def update_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each memory, and how many writes of them changed nothing."""
    return updates.replays(_replayed(spark, sf_dir)).groupBy("memory").agg(F.count(F.lit(1)).alias("blocks"), F.sum("replayed").alias("replayed"))


def update_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a log that a stream wrote, with their conflicts."""
    out, checkpoint = new_path(spark, "log"), new_path(spark, "log-checkpoint")
    items = block_items(memory.read_turns(spark, f"{sf_dir}/conversations.parquet*"))
    memory.run_log(items, out, checkpoint).awaitTermination()
    log = spark.read.schema(f"{items.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(out).drop("batch")
    flagged = updates.with_conflicts(updates.updated_entries(log))
    return flagged.select("memory", "entry", "m", F.array_join("src", ",").alias("src"), "entity", "moment", F.unix_timestamp("written").alias("written"), "conflict", "current")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = new_path(spark, "memories"), new_path(spark, "memories-checkpoint")
    memory.run(write_columns(memory.read_turns(spark, f"{sf_dir}/conversations.parquet*")), out, checkpoint).awaitTermination()
    return memory.rows_at(spark, out)


def stream_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every memory after the stream of all writes."""
    return memory.entries_of(_streamed(spark, sf_dir)).withColumn("src", F.array_join("src", ","))


def stream_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every memory after the stream of all writes."""
    return memory.sources_of(_streamed(spark, sf_dir))


_UPDATED = r"""i AS (SELECT conv_id AS memory, ['Flat', 'Graph'][conv_id % 2 + 1] || (turn // 2 * 2 % 3) || '/' || ((turn // 2 * 2 + 1) % 3) AS given, 1700000000 + turn // 2 * 60 + conv_id AS written, turn % 2 AS item,
    regexp_replace(trim(text), '^\s+|\s+$', '', 'g') AS m, [(turn % 5)::VARCHAR] AS src, role AS entity, CASE WHEN turn % 7 = 6 THEN NULL ELSE turn // 4 END AS moment, conv_id % 2 AS g,
    list_sort([turn // 2 * 2 % 3, (turn // 2 * 2 + 1) % 3]) AS ids FROM conversations),
  b AS (SELECT *, min(written) OVER (PARTITION BY memory, ids) AS first FROM i),
  k AS (SELECT * FROM b WHERE written = first AND m <> ''),
  e AS (SELECT *, row_number() OVER (PARTITION BY memory ORDER BY at_first) - 1 AS entry FROM (
    SELECT memory, src, min((written, item)) AS at_first, max_by(m, (written, item)) AS m, max_by(entity, (written, item)) AS entity, max_by(moment, (written, item)) AS moment, max(written) AS written FROM k GROUP BY memory, src)),
  s AS (SELECT memory, entity, moment, min(m) <> max(m) AS differ, max((written, entry)) AS last FROM e WHERE entity IS NOT NULL AND moment IS NOT NULL GROUP BY ALL),
  f AS (SELECT e.*, coalesce(s.differ, false) AS conflict, NOT coalesce(s.differ, false) OR (e.written, e.entry) = s.last AS current
    FROM e LEFT JOIN s ON s.memory = e.memory AND s.entity = e.entity AND s.moment = e.moment)"""
_FLAGGED = f"WITH {_UPDATED} SELECT memory, entry, m, array_to_string(src, ',') AS src, entity, moment, written, conflict, current FROM f"

QUERIES = {
    "update_entries": (update_entries, _FLAGGED),
    "update_readable": (update_readable, f"WITH {_UPDATED} SELECT memory, entry, m, array_to_string(src, ',') AS src FROM f WHERE current"),
    "update_replays": (update_replays, f"WITH {_UPDATED} SELECT memory, count(*) AS blocks, sum(n - 1)::BIGINT AS replayed FROM (SELECT memory, ids, count(DISTINCT written) AS n FROM i GROUP BY ALL) GROUP BY ALL"),
    "update_log_stream": (update_log_stream, _FLAGGED),
    "stream_entries": (stream_entries, f"WITH {_ENTRIES} SELECT memory, entry, m, array_to_string(src, ',') AS src, version FROM e"),
    "stream_sources": (stream_sources, f"WITH {_ENTRIES} SELECT * FROM s"),
}
