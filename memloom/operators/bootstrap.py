"""Resampling with replacement where the rows are: each row draws how often it counts, and only sums leave a task.

The number of times that a row is picked is a Poisson count of mean 1, from a portable generator by the row's id and the draw. So no row is copied,
rows are dealt over all cores whatever their group, groups are of any size, and the same draws can be made in any engine with 64-bit integers. A draw's sample size varies about that of the group;
the mean is over what was picked.

Where each draw must pick as many rows as its group has, ``picked_means`` does so: units of work are a block of gaps and a range of draws.
"""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.scratch import materialize

#: A prime modulus and multipliers of the generator; all products stay below 2^63.
PRIME, STEPS = 2_147_483_647, (48_271, 69_621, 16_807)
#: Numbers from which on a row is picked once, twice, and so on: shares of a Poisson distribution of mean 1.
LIMITS = [int(PRIME * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(12)]
#: Rows that are worked on at once, and groups whose sums a task holds.
ROWS, GROUPS = 256, 64
#: Gaps of a block, draws of a unit of work, and picks that are made at once.
BLOCK, RANGE, PICKS = 1 << 20, 50, 1 << 18


def pick_sql(k: str, draw: str, seed: int) -> str:
    """SQL of a number from 0 to PRIME that stands for a row (id ``k``) in a draw; the same in every engine with 64-bit integers."""
    x = f"((({k}) % {PRIME} * {STEPS[0]} + {draw} * {STEPS[1]} + {seed} * 7919) % {PRIME})"
    for step in STEPS:
        x = f"(({x} % 46337 * ({x} % 46327) + {x} % 104729 * {step}) % {PRIME})" if step == STEPS[1] else f"({x} * {step} % {PRIME})"
    return x


def counts_sql(pick: str) -> str:
    """SQL of how often a row is picked, by its number."""
    return "CASE " + " ".join(f"WHEN {pick} < {limit} THEN {k}" for k, limit in enumerate(LIMITS)) + f" ELSE {len(LIMITS)} END"


def numbers(ids: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """The number of :func:`pick_sql` of each row (ids) in each draw: rows x draws."""
    x = ((ids % PRIME)[:, None] * STEPS[0] + draws[None, :] * STEPS[1] + seed * 7919) % PRIME
    for step in STEPS:
        x = (x % 46337 * (x % 46327) + x % 104729 * step) % PRIME if step == STEPS[1] else x * step % PRIME
    return x


def counts(ids: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each row (ids) is picked in each draw (from 1): rows x draws."""
    return np.searchsorted(LIMITS, numbers(ids, np.arange(1, draws + 1, dtype=np.int64), seed), side="right")


def resampled_means(values: DataFrame, group: str, draws: int, seed: int) -> DataFrame:
    """``group, draw, mean``: the mean gap of each of ``draws`` resamples of each group; null where a draw picks nothing.

    ``values``: group (text), id (0 or more, different in a group), gap. A task sends a row per group and draw, whatever its number of rows.
    """

    def run(batches):
        held: dict = {}

        def sums():
            for name, (picked, total) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * draws, pa.string()), pa.array(np.arange(1, draws + 1)), pa.array(picked), pa.array(total)], names=["g", "draw", "picked", "total"])
            held.clear()

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            ids, gaps = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in dict.fromkeys(names):
                if len(held) >= GROUPS and name not in held:
                    yield from sums()
                picked, total = held.setdefault(name, (np.zeros(draws, np.int64), np.zeros(draws)))
                at = np.flatnonzero(names == name)
                for k in range(0, len(at), ROWS):
                    often = counts(ids[at[k : k + ROWS]], draws, seed)
                    picked += often.sum(axis=0)
                    total += gaps[at[k : k + ROWS]] @ often
        yield from sums()

    rows = values.select(F.col(group).cast("string"), F.col("id").cast("long"), F.col("gap").cast("double")).where("gap IS NOT NULL")
    rows = rows.repartition(values.sparkSession.sparkContext.defaultParallelism)  # few bytes, but thousands of draws each
    parts = rows.mapInArrow(run, "g string, draw long, picked long, total double")
    return parts.groupBy(F.col("g").alias(group), "draw").agg((F.sum("total") / F.nullif(F.sum("picked"), F.lit(0))).alias("mean"))


def numbered(values: DataFrame, group: str) -> DataFrame:
    """Adds ``k``, the place (from 1) of a row in its group by id, and ``n``, the rows of the group. No group is in one task."""
    # stored, as another run of the plan may cut the parts elsewhere
    parts = materialize(values.repartitionByRange(group, "id").withColumn("_p", F.spark_partition_id()), "parts")
    parts = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p", group).orderBy("id")))
    sizes = parts.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))  # a row per part and group
    before = sizes.select(group, "_p", "_n", (F.sum("_n").over(Window.partitionBy(group).orderBy("_p")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    return parts.join(before.drop("_n"), [group, "_p"]).withColumn("k", F.col("_before") + F.col("_k")).drop("_p", "_k", "_before")


def picked_means(values: DataFrame, group: str, draws: int, seed: int, block: int = BLOCK) -> DataFrame:
    """``group, draw, mean``: the mean of as many rows as the group has, picked with replacement, for each of ``draws`` draws.

    ``values``: group (text), id (different in a group), gap; rows without a gap are left out. A unit of work makes all picks of its draws and sums those that
    fall into its block, so that no pick is a row of a table; groups of over ``block`` rows make each pick once a block.
    """

    def run(batches):
        for batch in batches:
            for name, part, n, first, gaps in zip(*(batch.column(x) for x in ("g", "part", "n", "first", "gaps")), strict=True):
                gap, n, low = gaps.values.to_numpy(), n.as_py(), first.as_py()
                mine = np.arange(part.as_py() * RANGE + 1, min(draws, (part.as_py() + 1) * RANGE) + 1, dtype=np.int64)
                total = np.zeros(len(mine))
                rows = max(1, PICKS // len(mine))
                for k in range(1, n + 1, rows):
                    at = numbers(np.arange(k, min(n, k + rows - 1) + 1, dtype=np.int64), mine, seed) % n - low
                    inside = (at >= 0) & (at < len(gap))
                    total += np.where(inside, gap[np.where(inside, at, 0)], 0.0).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(mine), pa.string()), pa.array(mine), pa.array([n] * len(mine), pa.int64()), pa.array(total)], names=["g", "draw", "n", "total"])

    rows = values.select(F.col(group).cast("string").alias("g"), F.col("id").cast("long"), F.col("gap").cast("double")).where("gap IS NOT NULL")
    rows = numbered(rows, "g").withColumn("first", F.expr(f"(k - 1) div {block} * {block}"))
    blocks = rows.groupBy("g", "n", "first").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "gap"))), lambda x: x["gap"]).alias("gaps"))
    units = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // RANGE))))
    units = units.repartition(values.sparkSession.sparkContext.defaultParallelism * 4, "g", "first", "part")
    parts = units.select("g", "part", "n", "first", "gaps").mapInArrow(run, "g string, draw long, n long, total double")
    return parts.groupBy(F.col("g").alias(group), "draw").agg((F.sum("total") / F.any_value("n")).alias("mean"))
