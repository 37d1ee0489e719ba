"""Greedy admission in order under caps: an item that does not fit is skipped, later ones still count.

A running sum cannot express that, so each unit's ordered items go through a fold. Units are bounded
(64 sources), so a unit's array is small; units spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admit(items: DataFrame, unit: str, order: list[str], costs: dict[str, int]) -> DataFrame:
    """The admitted items of each unit.

    ``costs``: cap by cost column; an item is admitted if no cap is passed with it. Returns unit, the
    order columns, the cost columns, and ``admitted``.
    """
    names = list(costs)
    item = F.struct(*order, *(F.col(c).cast("long").alias(c) for c in names))
    units = items.groupBy(unit).agg(F.array_sort(F.collect_list(item)).alias("items"))
    fits = " AND ".join(f"s.{c} + x.{c} <= {cap}" for c, cap in costs.items())
    zero = ", ".join(f"'{c}', 0L" for c in names)
    taken = ", ".join(f"'{c}', s.{c} + if({fits}, x.{c}, 0L)" for c in names)
    fold = f"aggregate(items, named_struct({zero}, 'flags', cast(array() AS array<boolean>)), (s, x) -> named_struct({taken}, 'flags', array_append(s.flags, {fits})), s -> s.flags)"
    marked = units.select(unit, F.explode(F.arrays_zip("items", F.expr(fold).alias("flags"))).alias("m"))
    return marked.select(unit, "m.items.*", F.col("m.flags").alias("admitted"))


def select_sources(candidates: DataFrame, most: int, cap_tokens: int, input_limit: int) -> DataFrame:
    """Every retrieved source of each question with ``selected``, ``place`` (1, 2, ... among the selected, else null) and ``cosine``.

    ``candidates``: question, source, rank, known (whether its block is there), tokens (of its body), cost (of its part of the input), ``q`` and ``v`` (unit vectors of question and
    source). In order of rank a source is selected if there are fewer than ``most`` and both sums stay within their caps; others are dropped and later ones still
    count. A source without a block is dropped; one with a block but without tokens or a vector raises. A question's candidates are a bounded list.
    """
    lacks = F.when(F.col("tokens").isNull(), "token_count").when(F.col("v").isNull() | F.col("q").isNull() | (F.size("v") != F.size("q")), "vectors")
    fails = F.raise_error(F.concat(F.lit("missing frozen "), lacks, F.lit(" for source "), F.col("source").cast("string")))
    rows = candidates.withColumn("tokens", F.when(F.col("known") & lacks.isNotNull(), fails.cast("long")).otherwise(F.col("tokens")))
    known = rows.where("known").withColumns({"one": F.lit(1), "tokens": F.col("tokens"), "cost": F.col("cost")})
    taken = admit(known, "question", ["rank", "source"], {"one": most, "tokens": cap_tokens, "cost": input_limit}).select("question", "rank", "source", "admitted")
    cosine = F.when(F.col("known"), F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda n, x: n + x))
    both = rows.withColumn("cosine", cosine).join(taken, ["question", "rank", "source"], "left").withColumn("selected", F.coalesce("admitted", F.lit(False)))
    place = F.sum(F.col("selected").cast("long")).over(Window.partitionBy("question").orderBy("rank", "source"))
    return both.select("question", "source", "rank", "selected", F.when(F.col("selected"), place).alias("place"), "cosine")
