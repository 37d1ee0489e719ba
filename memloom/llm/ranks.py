"""Places and running sums within keys of any size.

A key may hold a third of all rows, so no window gathers a key: rows are dealt by ranges of key and
order, and what lies before a range is added from one row per range and key; sums run inside blocks of
a bounded number of places, and what lies before a block is added likewise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.sources.scratch import materialize

#: Places of a block of a running sum.
BLOCK = 1 << 16
#: Bits of monotonically_increasing_id() that number the rows of a partition.
_ROW_BITS = 33


def positions(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place of each (from 0) among those of its key in order of ``order``.

    ``rows`` is read twice and so should be a stored table; ``key`` is never null, and no two rows are equal in key and order,
    so that equal rows of a hot key can lie in several ranges.
    """
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    ordered = ordered.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    runs = ordered.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    placed = ordered.join(runs, [key, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_at", "_part", "_first", "_before")


def running_sums(rows: DataFrame, key: str, place: str, sums: dict[str, str], block: int = BLOCK) -> DataFrame:
    """``rows`` with the sum of each column over the rows of its key up to this one in order of ``place``: new name -> column.

    Places of a key are different numbers from 0. Keys whose places all lie in the first block need no second step.
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / F.lit(block)))
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({new: F.sum(old).over(inside) for new, old in sums.items()})
    long_keys = rows.where("_block > 0").select(key).distinct()
    totals = rows.join(long_keys, key, "left_semi").groupBy(key, "_block").agg(*(F.sum(old).alias(f"_sum_{new}") for new, old in sums.items()))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_block", *(F.sum(f"_sum_{new}").over(earlier).alias(f"_before_{new}") for new in sums))
    out = local.join(before, [key, "_block"], "left")
    out = out.withColumns({new: F.col(new) + F.coalesce(F.col(f"_before_{new}"), F.lit(0)) for new in sums})
    return out.drop("_block", *(f"_before_{new}" for new in sums))
