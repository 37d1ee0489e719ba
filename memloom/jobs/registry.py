"""All registered queries of the library, and the DuckDB statements that give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memloom.jobs import checks, compilation, domain, evaluation, features, memory, persistent, policy, report, retrieval, screening, selection, text, updates, usage

#: Modules of memloom.jobs with QUERIES: name -> (function, SQL or None).
MODULES = [retrieval, text, memory, domain, compilation, usage, policy, persistent, report, checks, features, screening, updates, selection, evaluation]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
