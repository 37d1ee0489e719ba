"""Evaluating a domain in order, one candidate of every open unit a round.

Evaluations are costly calls, so a unit stops as soon as nothing that is left can change its answer. All units move on together: a
round joins the order with what is known, evaluates the next candidates, and stores them as a table. Rounds that are stored are not run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.domain import FULL, bounds, ids_of
from memloom.sources.scratch import materialize

STATUSES = ("PASS", "FAIL", "UNKNOWN")
#: Rounds after which their tables are written as one.
GATHER = 16


def in_order(sets: DataFrame, *keys: str) -> DataFrame:
    """Sets with ``place`` from 1: the full set, then by cost, then by ids."""
    order = Window.partitionBy(*keys).orderBy(F.expr(f"mask <> {FULL}"), "cost", "_ids")
    return sets.withColumn("_ids", ids_of("mask")).withColumn("place", F.row_number().over(order).cast("long")).drop("_ids")


def next_candidates(order: DataFrame, records: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """The next set of each unit that is still open: there is one left within the limit, and it is cheaper than any that is known to pass within reach."""
    known = records.groupBy(*keys).agg(F.max("place").alias("_done"), F.min(F.when((F.col("status") == "PASS") & F.col("reached"), F.col("cost"))).alias("_best"))
    left = order.join(known, list(keys), "left").where(F.col("place") == F.coalesce("_done", F.lit(0)) + 1)
    left = left.where(F.col("_best").isNull() | (F.col("cost") < F.col("_best")))
    return (left if limit is None else left.where(F.col("place") <= limit)).drop("_done", "_best")


def compile_domain(sets: DataFrame, evaluate: Callable[[DataFrame], DataFrame], *keys: str, limit: int | None = None, records: DataFrame | None = None) -> DataFrame:
    """``keys, mask, cost, reached, place, status`` of the sets that were evaluated.

    ``sets``: keys, n, mask, cost and ``reached`` (whether the budget reaches it); sets out of reach take no part, but for the full set, which comes first.
    ``evaluate`` adds ``status`` to the rows of a round; any other status than PASS, FAIL or UNKNOWN raises an error. A unit ends when no set in reach
    that is cheaper than its cheapest passing one is left, or after ``limit`` evaluations. ``records``: evaluations of an earlier run, which are kept.
    """
    others = [*keys, "mask", "cost", "reached", "place"]
    order = materialize(in_order(sets.where(F.col("reached") | F.expr(f"mask = {FULL}")), *keys), "order")
    empty = order.select(*others, F.lit(None).cast("string").alias("status")).limit(0)
    records, rounds = empty if records is None else records, 0
    while True:
        rows = evaluate(next_candidates(order, records, *keys, limit=limit))
        checked = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.lit("unknown status")).cast("string"))
        done = materialize(rows.select(*others, checked.alias("status")), "round")
        if done.isEmpty():
            return records
        records, rounds = records.unionByName(done), rounds + 1
        if rounds % GATHER == 0:
            records = materialize(records, "rounds")


def certificate(sets: DataFrame, records: DataFrame, *keys: str) -> DataFrame:
    """Cost bounds of each unit over the sets in reach, and ``evaluations``, the number of sets that were evaluated."""
    seen = sets.where("reached").join(records.select(*keys, "mask", "status"), [*keys, "mask"], "left")
    count = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("evaluations"))
    return bounds(seen, *keys).join(count, list(keys), "left")
