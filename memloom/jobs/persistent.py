"""The memory state: a conversation is a memory, its turns are write batches, its last turn asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import state
from memloom.sources.tables import table


def write_columns(turns: DataFrame) -> DataFrame:
    """Turns as writes of statements and sources, as below; works on a table and on a stream."""
    src = "if(turn % 5 = 4, NULL, array_distinct(array(string(turn * 2 % 3), string(turn % 3))))"
    m = "if(turn % 9 = 8, ' ', text)"
    return turns.selectExpr("conv_id AS memory", "turn div 2 + 1 AS version", "turn AS place", f"{m} AS m", f"{src} AS src", "string(turn % 3) AS source_id", "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("memory"), F.col("turn").alias("place"), "text")


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns are a batch; every fifth statement has no sources and every ninth is empty."""
    src = F.expr("if(place % 5 = 4, NULL, array_distinct(array(string(place * 2 % 3), string(place % 3))))")
    return _turns(spark, sf_dir).select("memory", F.expr("place div 2 + 1").alias("version"), "place", F.expr("if(place % 9 = 8, ' ', text)").alias("m"), src.alias("src"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sources_after(_turns(spark, sf_dir).withColumn("source_id", F.expr("string(place % 3)")))


def _retrieved(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    asked = _turns(spark, sf_dir).groupBy("memory").agg(F.max("place").alias("query_id"), F.max_by("text", "place").alias("query"))
    return state.retrieve(state.entries_after(_writes(spark, sf_dir)), _sources(spark, sf_dir), asked, k)


def state_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every memory after all writes, sources joined by commas."""
    return state.entries_after(_writes(spark, sf_dir)).withColumn("src", F.array_join("src", ","))


def state_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every memory after all writes."""
    return _sources(spark, sf_dir)


def state_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 entries of each memory that its last turn retrieves."""
    return _retrieved(spark, sf_dir).select("memory", "query_id", "entry", F.round("score", 9).alias("score"), "rank")


def state_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was retrieved as a text."""
    return state.render(_retrieved(spark, sf_dir))


_ENTRIES = r"""t AS (SELECT conv_id AS memory, turn AS place, text FROM conversations),
  w AS (SELECT memory, place // 2 + 1 AS version, place, regexp_replace(CASE WHEN place % 9 = 8 THEN ' ' ELSE text END, '^\s+|\s+$', '', 'g') AS m,
    CASE WHEN place % 5 = 4 THEN [] ELSE list_sort(list_distinct([(place * 2 % 3)::VARCHAR, (place % 3)::VARCHAR])) END AS src FROM t),
  k AS (SELECT *, CASE WHEN len(src) > 0 THEN 'p:' || array_to_string(src, ',') ELSE 't:' || regexp_replace(lower(m), '\s+', ' ', 'g') END AS key FROM w WHERE m <> ''),
  e AS (SELECT *, row_number() OVER (PARTITION BY memory ORDER BY first) - 1 AS entry FROM (
    SELECT memory, key, min(place) AS first, max_by(m, place) AS m, max_by(src, place) AS src, max_by(version, place) AS version FROM k GROUP BY ALL)),
  s AS (SELECT memory, (place % 3)::VARCHAR AS source_id, max_by(text, place) AS text FROM t GROUP BY ALL)"""
_RETRIEVED = rf"""{_ENTRIES},
  x AS (SELECT memory, entry, string_agg(text, ' ' ORDER BY source_id) AS texts FROM (SELECT memory, entry, unnest(src) AS source_id FROM e) JOIN s USING (memory, source_id) GROUP BY ALL),
  q AS (SELECT memory, max(place) AS query_id, max_by(text, place) AS query FROM t GROUP BY 1),
  z AS (SELECT e.memory, query_id, e.entry, m, src, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(m || ' ' || coalesce(texts, '')), '[a-z0-9]+')) AS b FROM e JOIN q ON q.memory = e.memory LEFT JOIN x ON x.memory = e.memory AND x.entry = e.entry),
  r AS (SELECT *, row_number() OVER (PARTITION BY memory ORDER BY score DESC, entry DESC) AS rank FROM (SELECT *, len(list_intersect(a, b)) / sqrt((greatest(1, len(a)) * greatest(1, len(b)))::DOUBLE) AS score FROM z))"""

QUERIES = {
    "state_entries": (state_entries, f"WITH {_ENTRIES} SELECT memory, entry, m, array_to_string(src, ',') AS src, version FROM e"),
    "state_sources": (state_sources, f"WITH {_ENTRIES} SELECT * FROM s"),
    "state_retrieve": (state_retrieve, f"WITH {_RETRIEVED} SELECT memory, query_id, entry, round(score, 9) AS score, rank FROM r WHERE rank <= 3"),
    "state_render": (state_render, f"WITH {_RETRIEVED} SELECT memory, query_id, 'Persistent memory:' || chr(10) || string_agg('[' || rank || '] ' || m || ' [src:' || array_to_string(src, ',') || ']', chr(10) ORDER BY rank) AS text FROM r WHERE rank <= 3 GROUP BY ALL"),
}
