"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation several times, each snapshot a few turns longer than the one
before. Rolling hashes of the turn prefixes find them: a conversation whose whole hash is the hash of a
proper prefix of another one is a snapshot of it. Anti-joins keep the maximal conversations, which
are then rendered as one training text each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands before a turn (%s: its role) and behind it.
BEFORE, AFTER = "<|%s|>\n", "\n<|end|>\n"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, k, a, b, n``: for each turn k of n the hash (two 64-bit values) of the turns up to it.

    A turn's hash takes in its place, so that the prefix hash, the exclusive or of the hashes up to
    it, depends on the order. Texts are hashed where they are read; the window has numbers only.
    """
    content = [F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    slim = turns.select("conv_id", "turn", F.xxhash64(*content).alias("h"), F.xxhash64(F.lit("b"), *content).alias("g"))
    order = Window.partitionBy("conv_id").orderBy("turn", "h", "g")
    placed = slim.withColumn("k", F.row_number().over(order).cast("long"))
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("conv_id", "k", F.bit_xor(F.xxhash64("k", "h")).over(so_far).alias("a"), F.bit_xor(F.xxhash64("k", "g")).over(so_far).alias("b"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns`` of the conversations that are no proper prefix of another and no copy of one with a smaller id.

    A first turn that very many conversations share is one row of the anti-join: prefixes are made
    distinct in part before they are shuffled.
    """
    prefixes = turn_prefixes(turns)
    whole = prefixes.where("k = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.where("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def collapse_and_render(turns: DataFrame, before: str = BEFORE, after: str = AFTER) -> DataFrame:
    """One row per maximal conversation: ``conv_id``, ``n_turns`` (long) and ``chat``, its turns in order as one text.

    ``turns``: conv_id, turn, role, text. Turns are in order of turn, equal ones of their content's
    hash; a repeated row is a turn of its own. A null role is written as unknown, a null text as empty;
    for comparison null and empty differ. Rows with a null conv_id are no conversation and are left out.
    Only the turns of maximal conversations are gathered, each conversation in one row.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    content = [F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    piece = F.concat(F.format_string(before.replace("%s", "%1$s"), F.coalesce("role", F.lit("unknown"))), F.coalesce("text", F.lit("")), F.lit(after))
    kept = rows.join(maximal(rows), "conv_id")
    items = kept.select("conv_id", "n_turns", F.struct("turn", F.xxhash64(*content).alias("h"), F.xxhash64(F.lit("b"), *content).alias("g"), piece.alias("piece")).alias("item"))
    out = items.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return out.select("conv_id", "n_turns", F.array_join(F.col("items.piece"), "").alias("chat"))


#: The same rows in DuckDB SQL for conversations whose turns are numbered once each.
DUCKDB_SQL = """
WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  p AS (SELECT conv_id, n, k, md5(roles[1:k]::VARCHAR || texts[1:k]::VARCHAR) AS h FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM c)),
  w AS (SELECT n, h, min(conv_id) AS conv_id FROM p WHERE k = n GROUP BY ALL),
  m AS (SELECT conv_id FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n AND p.h = w.h))
SELECT conv_id, n AS n_turns, array_to_string(list_transform(range(1, n + 1), lambda i: '<|' || coalesce(roles[i], 'unknown') || '|>' || chr(10) || coalesce(texts[i], '') || chr(10) || '<|end|>' || chr(10)), '') AS chat
FROM c WHERE conv_id IN (SELECT conv_id FROM m)"""
