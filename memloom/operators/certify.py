"""Three-valued audits and unit metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(good: Column, bad: Column) -> Column:
    """PASS, FAIL or UNKNOWN from two conditions; both null or false is UNKNOWN."""
    return F.when(bad, "FAIL").when(good, "PASS").otherwise("UNKNOWN")


def worst(*statuses: Column) -> Column:
    """FAIL beats UNKNOWN beats PASS."""
    every = F.array(*statuses)
    return F.when(F.array_contains(every, "FAIL"), "FAIL").when(F.array_contains(every, "UNKNOWN"), "UNKNOWN").otherwise("PASS")


def guarded_sum(value: Column, complete: Column | None = None) -> Column:
    """The sum if every row has a value (and is complete), else null; 0 over no rows."""
    known = value.isNotNull() if complete is None else value.isNotNull() & complete
    return F.when(F.coalesce(F.bool_and(F.coalesce(known, F.lit(False))), F.lit(True)), F.coalesce(F.sum(value), F.lit(0)))
