"""From score rows, audit records and annotations to the tables of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_totals(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """``group, field, avg, known_items, total`` of each field: the total only if every row has a value. One aggregate for all fields."""
    parts = [f(x) for x in fields for f in (lambda x: F.avg(x).alias(f"a_{x}"), lambda x: F.count(x).alias(f"k_{x}"), lambda x: F.sum(F.col(x).cast("long")).alias(f"t_{x}"))]
    flat = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), *parts)
    stack = ", ".join(f"'{x}', a_{x}, k_{x}, if(k_{x} = _n, t_{x}, NULL)" for x in fields)
    return flat.select(group, F.expr(f"stack({len(fields)}, {stack}) AS (field, avg, known_items, total)"))


def evidence_tokens(evidence: DataFrame, *keys: str) -> DataFrame:
    """``keys, evidence_tokens`` of each run; a source without a token count is an error."""
    count = F.when(F.col("token_count").isNull(), F.raise_error(F.lit("missing token_count of a source")).cast("long")).otherwise(F.col("token_count").cast("long"))
    return evidence.groupBy(*keys).agg(F.sum(count).alias("evidence_tokens"))


def audit_averages(records: DataFrame) -> DataFrame:
    """Per arm: runs, mean evidence tokens, mean builder tokens over the runs that know them, mean number of memories."""
    mean = lambda name: F.avg(F.coalesce(name, F.lit(0)))
    return records.groupBy("arm").agg(F.count(F.lit(1)).alias("runs"), mean("evidence_tokens").alias("avg_evidence_tokens"), F.avg("builder_tokens").alias("avg_builder_tokens"), F.count("builder_tokens").alias("builder_tokens_known_items"), mean("memory_count").alias("avg_memory_count"))


def audit_counts(records: DataFrame) -> DataFrame:
    """``arm, kind, name, n``: runs by status (that of the construction first) and by fallback, where there was one."""
    status = F.coalesce(F.nullif("construction_status", F.lit("")), F.nullif("status", F.lit("")), F.lit("unknown"))
    names = F.array(F.struct(F.lit("status").alias("kind"), status.alias("name")), F.struct(F.lit("fallback").alias("kind"), F.nullif("fallback", F.lit("")).alias("name")))
    return records.select("arm", F.explode(names).alias("x")).where("x.name IS NOT NULL").groupBy("arm", "x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


def completeness(rows: DataFrame, arm: str, *keys: str) -> DataFrame:
    """Per arm: expected keys (those that any arm has), how many it lacks, rows that repeat a key, and whether it is complete."""
    counted = rows.groupBy(arm, *keys).agg(F.count(F.lit(1)).alias("n"))
    expected = counted.select(*keys).distinct().agg(F.count(F.lit(1)).alias("expected"))
    found = counted.groupBy(arm).agg(F.count(F.lit(1)).alias("found"), F.sum(F.col("n") - 1).alias("repeated"))
    out = found.withColumn("_k", F.lit(1)).join(expected.withColumn("_k", F.lit(1)), "_k").select(arm, "expected", (F.col("expected") - F.col("found")).alias("missing"), "repeated")
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("repeated") == 0))


def gold_counts(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """``qa_id, split, gold, mapped, candidates``: pieces of evidence of each question, and how many of its candidates hold one.

    ``questions``: qa_id, split, evidence (array of dialogue ids). ``candidates``: qa_id, position, dia_id, source_id; the last
    part but one of a source id (``sample:D1:3:0``: between its last colons) stands for the dialogue id too.
    """
    parts = F.split("source_id", ":")
    of_source = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.col("source_id"))
    held = candidates.join(questions.select("qa_id", "evidence"), "qa_id").where(F.array_contains("evidence", F.col("dia_id")) | F.array_contains("evidence", of_source))
    mapped = held.groupBy("qa_id").agg(F.count_distinct("position").alias("mapped"))
    sizes = candidates.groupBy("qa_id").agg(F.count(F.lit(1)).alias("candidates"))
    out = questions.select("qa_id", F.coalesce("split", F.lit("unknown")).alias("split"), F.size(F.coalesce("evidence", F.array().cast("array<string>"))).cast("long").alias("gold"))
    return out.join(mapped, "qa_id", "left").join(sizes, "qa_id", "left").fillna(0, ["mapped", "candidates"])


def complete_gold() -> Column:
    """Over :func:`gold_counts`: a question with evidence, all of it mapped."""
    return (F.col("gold") > 0) & (F.col("mapped") == F.col("gold"))


def coverage(counts: DataFrame, examples: int = 10) -> DataFrame:
    """Per split: questions with complete, partial and no evidence among their candidates, both shares, and the first ids without."""
    complete = complete_gold()
    flat = counts.groupBy("split").agg(
        F.count(F.lit(1)).alias("qas"), F.count_if(complete).alias("complete"), F.count_if(~complete & (F.col("mapped") > 0)).alias("partial"), F.count_if(F.col("mapped") == 0).alias("none"),
        F.sum("gold").alias("gold_evidence_blocks"), F.sum("mapped").alias("mapped_evidence_blocks"),
    )
    order = Window.partitionBy("split").orderBy("qa_id")
    first = counts.where("mapped = 0").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= examples).groupBy("split").agg(F.array_sort(F.collect_list("qa_id")).alias("missing_examples"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return flat.join(first, "split", "left").withColumns({"qa_coverage": share("complete", "qas"), "evidence_coverage": share("mapped_evidence_blocks", "gold_evidence_blocks")})
