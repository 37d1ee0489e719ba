"""Checking requirement annotations and numbering their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_REQUIREMENTS, MAX_PACKAGES, MAX_SOURCES = 6, 3, 64


def annotation_reason(requirements: str, n_sources: str) -> Column:
    """Why an annotation is not valid, null if it is.

    ``requirements``: array of structs of ``id`` and ``packages`` (array of arrays of source ids, which run from 1).
    """
    r = requirements
    return F.expr(f"""CASE
      WHEN {r} IS NULL OR size({r}) = 0 THEN 'no requirements'
      WHEN size({r}) > {MAX_REQUIREMENTS} THEN 'too many requirements'
      WHEN size(array_distinct(transform({r}, x -> x.id))) < size({r}) THEN 'repeated requirement'
      WHEN exists({r}, x -> x.packages IS NULL OR size(x.packages) NOT BETWEEN 1 AND {MAX_PACKAGES}) THEN 'package count'
      WHEN exists({r}, x -> exists(x.packages, p -> size(p) = 0 OR size(array_distinct(p)) < size(p))) THEN 'empty or repeated sources'
      WHEN exists({r}, x -> exists(x.packages, p -> exists(p, i -> i NOT BETWEEN 1 AND {n_sources}))) THEN 'unknown source'
    END""")


def normalize_sources(rows: DataFrame, unit: str, order: list[str], given: str) -> DataFrame:
    """Adds ``id``: the given ids of a unit if all are positive and differ, else 1 .. n in order for the whole unit."""
    over = Window.partitionBy(unit)
    distinct = F.size(F.collect_set(given).over(over))
    fine = (F.coalesce(F.min(given).over(over), F.lit(0)) > 0) & (distinct == F.count(F.lit(1)).over(over))
    place = F.row_number().over(over.orderBy(*order))
    return rows.withColumn("id", F.when(fine, F.col(given)).otherwise(place).cast("long"))
