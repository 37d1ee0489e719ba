"""The retrieval cache: one row per question with its ranked sources, checks of its rows, and refreshed recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(fused: DataFrame, lexical: DataFrame, dense: DataFrame, evidence: DataFrame, questions: DataFrame, *keys: str) -> DataFrame:
    """One row per question: ``source_ids`` and ``scores`` in order, ``bm25_rank`` and ``dense_rank`` (maps by source), ``evidence_recall``.

    ``fused``: keys, source_id, score, rank. ``lexical``, ``dense``: keys, source_id, rank. ``evidence``: keys, source_id,
    repeats counting each time. A question without evidence has recall 1, and one that found nothing has empty arrays. Rankings are cut to k, so arrays are bounded.
    """
    order = lambda name: F.col(f"ranked.{name}")
    found = fused.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "source_id", "score"))).alias("ranked"))
    ranks = lambda x, name: x.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "rank")))).alias(name))
    wanted = evidence.groupBy(*keys).agg(F.collect_list("source_id").alias("wanted"))
    out = questions.select(*keys)
    for part in (found, ranks(lexical, "bm25_rank"), ranks(dense, "dense_rank"), wanted):
        out = out.join(part, list(keys), "left")
    out = out.withColumn("source_ids", F.coalesce(order("source_id"), F.array().cast(fused.select(F.array("source_id")).schema[0].dataType)))
    return out.select(*keys, "source_ids", F.coalesce(order("score"), F.array().cast("array<double>")).alias("scores"), "bm25_rank", "dense_rank", recall("wanted", "source_ids").alias("evidence_recall"))


def recall(wanted: str, found: str) -> Column:
    """Share of ``wanted`` (array, repeats counting each time) in ``found``; 1 for none."""
    share = F.size(F.filter(wanted, lambda x: F.array_contains(found, x))) / F.nullif(F.size(wanted).cast("double"), F.lit(0.0))
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) < 1, F.lit(1.0)).otherwise(share)


def problems(rows: DataFrame, questions: DataFrame, *keys: str) -> DataFrame:
    """``keys, problem`` of a cache that must have one row for each question: repeated, unknown or missing rows, and rows with a score that isn't finite or fewer scores than sources."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.exists("scores", lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))) | (F.size("scores") != F.size("source_ids"))).alias("bad"))
    both = counts.join(questions.select(*keys).distinct().withColumn("_q", F.lit(True)), list(keys), "full_outer")
    found = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated"), F.when(F.col("_q").isNull(), "unknown"), F.when(F.col("n").isNull(), "missing"), F.when(F.col("bad"), "scores")))
    return both.select(*keys, F.explode(found).alias("problem"))


def refreshed(rows: DataFrame, evidence: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``evidence_recall`` computed anew from ``evidence`` (keys, ``wanted``: array); rankings stay as they are.

    Check :func:`problems` first: rows of unknown questions would count as questions without evidence.
    """
    return rows.drop("evidence_recall").join(evidence, list(keys), "left").withColumn("evidence_recall", recall("wanted", "source_ids")).drop("wanted")
