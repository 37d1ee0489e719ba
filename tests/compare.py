"""Run a query on Spark and its twin on DuckDB, and compare rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def rows_of(values):
    return sorted(tuple(repr(v) for v in row) for row in values)


def compare(spark, run, sql: str, folder: str) -> int:
    """Assert equal columns and rows; returns the number of rows."""
    df = run(spark, folder)
    relation = connection(folder).sql(sql)
    columns = sorted(relation.columns)
    assert sorted(df.columns) == columns
    got = rows_of(tuple(r) for r in df.select(*columns).collect())
    want = rows_of(relation.select(*(f'"{c}"' for c in columns)).fetchall())
    assert got == want
    return len(got)
