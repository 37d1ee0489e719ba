"""Connected components of very large edge tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.sources.scratch import drop, materialize


def unsent(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a join that is never broadcast.

    Broadcasts are chosen by the compressed bytes of a shuffle or a file; the table that the driver builds of these is some twenty times as large where rows are few numbers.
    """
    return rows.hint("merge")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every node of ``edges``: the smallest id that its edges reach.

    Edges may repeat, and loops are ignored; rows with a null end are ignored. Each round
    hooks every node to the smallest id around it: first its larger neighbours (large star), then
    its smaller ones (small star). Rounds end when the edges are stars around the smallest ids;
    their number grows with the logarithm of the longest path. Each round is written as a table
    in the shared folder, so a lost executor costs a round at most; the table of the round before is deleted then. A node with very many edges is
    only ever aggregated in parts and joined, never gathered.
    """
    stars = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    stars = materialize(stars.distinct(), "edges")
    before = None
    while True:
        state = stars.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state.n or state == before:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(unsent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        drop(stars)
        joined = large.join(unsent(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        small = joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        stars = materialize(small.distinct(), "small-star")
        drop(large)
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
