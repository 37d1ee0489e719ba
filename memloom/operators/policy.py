"""Sequence model over source sets: increasing ids, then STOP, under a budget.

The scorer is a column expression, so that any model's logits can stand in. A unit's prefixes are
its reachable sets, a bounded number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.domain import CHECKED
from memloom.sources.scratch import materialize


def logsumexp(column: str, *keys: str) -> Column:
    """Stable log of the sum of exponentials over the rows of ``keys``."""
    over = Window.partitionBy(*keys)
    top = F.max(column).over(over)
    return top + F.log(F.sum(F.exp(F.col(column) - top)).over(over))


def additive(grown: DataFrame) -> DataFrame:
    """Sets cost what their sources cost together; ``grown`` has the cost of the set before, and ``costs``."""
    return grown.withColumn("cost", F.col("cost") + F.expr("get(costs, last - 1)"))


def prefixes(units: DataFrame, budget: int, price: Callable[[DataFrame], DataFrame] = additive) -> DataFrame:
    """``unit, n, mask, cost, last, size``: every set whose sorted prefixes all cost at most the budget.

    ``units``: unit, n at most 64 (more raise an error), and what ``price`` needs: it gives grown sets (unit, n, mask, last, size, cost of the set they
    grew from) their own cost, by any rule. Sets grow as rows, a source a level, and a level is a stored table: a unit with very many of them spreads over tasks.
    The empty set costs 0.
    """
    checked = F.expr(CHECKED.format(value="n"))
    level = materialize(units.withColumn("n", checked).withColumns({"mask": F.lit(0).cast("long"), "cost": F.lit(0).cast("long"), "last": F.lit(0), "size": F.lit(0)}).where(F.lit(budget) >= 0), "sets")
    kept, columns = level, ["unit", "n", "mask", "cost", "last", "size"]
    while not level.isEmpty():
        # a set spreads over tasks by itself: its unit may hold most of them
        grown = level.where("last < n").repartition("unit", "mask").withColumn("_id", F.explode(F.expr("sequence(last + 1, int(n))")))
        grown = grown.withColumns({"mask": F.expr("mask | shiftleft(1L, _id - 1)"), "last": F.col("_id"), "size": F.col("size") + 1}).drop("_id")
        level = materialize(price(grown).where(F.col("cost") <= budget), "sets")
        kept = kept.select(*columns).unionByName(level.select(*columns))
    return kept.select(*columns)


def action_logps(sets: DataFrame, logit: Column, stop_logit: Column) -> DataFrame:
    """Log-probability of every legal action at every prefix: adding a larger id that stays reachable, or STOP (id 0).

    ``logit`` may use id, size and unit; ``stop_logit`` size and unit.
    """
    grown = sets.where("mask <> 0").select("unit", F.expr("mask ^ shiftleft(1L, greatest(last - 1, 0))").alias("mask"), F.col("last").alias("id"), (F.col("size") - 1).alias("size"), F.col("mask").alias("next"))
    added = grown.withColumn("logit", logit)
    stopped = sets.select("unit", "mask", F.lit(0).alias("id"), "size", F.col("mask").alias("next")).withColumn("logit", stop_logit)
    every = added.unionByName(stopped)
    return every.withColumn("logp", F.col("logit") - logsumexp("logit", "unit", "mask")).drop("logit")


def ids_key(mask: str = "mask", sign: int = 1) -> Column:
    """The sorted ids in a mask as an array to order by; with sign -1 negated, so that smaller ids and then longer sets come last."""
    return F.expr(f"transform(filter(sequence(1, 64), i -> (shiftright({mask}, i - 1) & 1) = 1), i -> {sign} * i)")


def best_set(scored: DataFrame, score: str) -> DataFrame:
    """The row of each unit with the best score; among equals the one with smaller ids, an extension before its own prefix."""
    order = Window.partitionBy("unit").orderBy(F.col(score).desc(), ids_key(sign=-1).desc())
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def sequence_logps(sets: DataFrame, actions: DataFrame) -> DataFrame:
    """``unit, mask, cost, logp``: the log-probability of ending with each set, along its sorted ids."""
    ids = F.expr("filter(sequence(0, int(n)), k -> k = 0 OR (shiftright(mask, k - 1) & 1) = 1)")
    steps = sets.select("unit", "mask", "cost", F.explode(ids).alias("k"), "last")
    before = F.expr("if(k = 0, mask, mask & ~shiftleft(-1L, greatest(k - 1, 0)))")
    steps = steps.select("unit", F.col("mask").alias("terminal"), "cost", before.alias("mask"), F.col("k").alias("id"))
    return steps.join(actions, ["unit", "mask", "id"]).groupBy("unit", F.col("terminal").alias("mask"), "cost").agg(F.sum("logp").alias("logp"))


def risk(logps: DataFrame, success: Column) -> DataFrame:
    """Per unit: minus log of the mass on successes, and the expected relative excess cost given success."""
    good = logps.where(success).withColumn("mass", F.exp("logp"))
    best = good.groupBy("unit").agg(F.min("cost").alias("best"))
    out = good.join(best, "unit").groupBy("unit").agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * (F.col("cost") - F.col("best")) / F.greatest("best", F.lit(1))).alias("x"))
    return out.select("unit", (-F.log("m")).alias("nll"), (F.col("x") / F.col("m")).alias("excess"))


def completions(actions: DataFrame, sets: DataFrame, width: int, depth: int | None = None) -> DataFrame:
    """``unit, mask, score``: the terminal sets that a beam of ``width`` prefixes meets within ``depth`` steps, or until no prefix is left.

    One level is one join and one ranking window. Among prefixes of equal scores smaller ids stay.
    """
    order = Window.partitionBy("unit").orderBy(F.round("score", 9).desc(), ids_key())
    state = sets.where("mask = 0").select("unit", "mask", F.lit(0.0).alias("score"))
    ended = None
    actions = materialize(actions, "actions")
    if depth is None:  # no prefix is longer than the largest set
        depth = sets.agg(F.max("size")).first()[0] or 0
    for _ in range(depth + 1):
        moved = state.join(actions, ["unit", "mask"]).select("unit", F.col("next").alias("mask"), (F.col("score") + F.col("logp")).alias("score"), "id")
        done = moved.where("id = 0").drop("id")
        ended = done if ended is None else ended.unionByName(done)
        state = moved.where("id <> 0").drop("id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= width).drop("r")
        if depth > 8:  # the plan of a long beam would hold every level many times
            state = materialize(state, "beam")
    return ended


def beam(actions: DataFrame, sets: DataFrame, width: int, depth: int | None = None) -> DataFrame:
    """The best of a beam's :func:`completions`; for ties see :func:`best_set`."""
    ended = completions(actions, sets, width, depth)
    return best_set(ended.withColumn("_score", F.round("score", 9)), "_score").drop("_score")


def best_sets(ended: DataFrame, top: int) -> DataFrame:
    """The ``top`` completions of each unit by score, among equals those with smaller ids."""
    order = Window.partitionBy("unit").orderBy(F.round("score", 9).desc(), ids_key())
    return ended.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")
