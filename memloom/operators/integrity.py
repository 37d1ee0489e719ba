"""Many constraints of a table in one scan, and artefacts that must agree with each other.

Constraints are counted while the rows pass, either as one aggregate or observed beside a write that happens anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _counts(constraints: dict[str, Column]) -> list[Column]:
    return [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in constraints.items()]


def violations(rows: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """``constraint, violations``: the rows for which a constraint isn't true (null counts as not). One scan, one row per task moves."""
    row = rows.agg(*_counts(constraints))
    each = F.array(*(F.struct(F.lit(name).alias("constraint"), F.col(f"`{name}`").alias("violations")) for name in constraints))
    return row.select(F.explode(each).alias("x")).select("x.*")


def observed(rows: DataFrame, constraints: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and what counts the violations, and the rows as ``rows``, while they are written: read ``.get`` after the write."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *_counts(constraints)), seen


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, copies`` of keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def disagreements(parts: dict[str, DataFrame], key: str, digest: str = "digest") -> DataFrame:
    """``key, problem, parts``: keys that a part lacks (``missing``), has several times (``repeated``), or on whose digest the parts differ (``differs``).

    ``parts``: name -> key, digest. One aggregate over all parts in place of a chain of joins; parts are named in order, joined by commas.
    """
    long = None
    for name, rows in parts.items():
        part = rows.select(F.col(key), F.col(digest).alias("_digest"), F.lit(name).alias("_part"))
        long = part if long is None else long.unionByName(part)
    once = long.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_digest").alias("_low"), F.max("_digest").alias("_high"))
    whole = once.groupBy(key).agg(F.collect_set("_part").alias("_there"), F.collect_set(F.when(F.col("_n") > 1, F.col("_part"))).alias("_often"), (F.min("_low") != F.max("_high")).alias("_differs"))
    names = F.array(*map(F.lit, parts))
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    problem = lambda name, found, who: F.when(found, F.struct(F.lit(name).alias("problem"), listed(who).alias("parts")))
    lost = F.array_except(names, "_there")
    each = F.array(problem("missing", F.size(lost) > 0, lost), problem("repeated", F.size("_often") > 0, F.col("_often")), problem("differs", F.col("_differs"), F.col("_there")))
    return whole.select(key, F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")
