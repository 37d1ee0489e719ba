"""Reports over score rows (events), audit records (orders and their lines) and questions of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.jobs.memory import _QUESTIONS, _TURNS
from memloom.jobs.usage import _SCORES, _scores
from memloom.operators import blocks, report
from memloom.sources.tables import table

# The cost fields of a score row.
FIELDS = """construction_prompt_tokens construction_completion_tokens construction_tokens construction_calls
agent_prompt_tokens agent_completion_tokens agent_total_tokens memory_read_tokens memory_read_tokens_estimate
selector_latency_ms retrieval_query_tokens retrieval_latency_ms total_latency_ms""".split()


def _field(i: int) -> str:
    """Stand-in of field i of an event, in SQL of both engines; every second field is always known."""
    value = f"cast(floor(value * {i + 1}) AS bigint)"
    return value if i % 2 else f"CASE WHEN event_id % {31 + i} = 3 THEN NULL ELSE {value} END"


def arm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cost field of each arm: average, known items, and the total where all are known."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("arm"), *(F.expr(_field(i)).alias(x) for i, x in enumerate(FIELDS)))
    return report.field_totals(rows, "arm", FIELDS).withColumn("avg", F.round("avg", 6))


def arm_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm: items with complete usage on either side, with a fallback, and mean elapsed seconds."""
    rows = table(spark, sf_dir, "events").withColumn("latency", F.expr("if(event_id % 13 = 5, NULL, floor(value * 10))"))
    return rows.groupBy(F.col("event_type").alias("arm")).agg(
        F.count_if(F.col("event_id") % 31 != 3).alias("construction_usage_complete_items"), F.count_if(F.col("event_id") % 3 != 1).alias("agent_usage_complete_items"),
        F.count_if(F.col("event_id") % 17 == 0).alias("fallback_items"), F.round(F.avg("latency") / 1000, 9).alias("avg_agent_elapsed_seconds"),
    )


def report_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each arm has a row for every (sample, category) of categories 1 to 4, and one only."""
    return report.completeness(_scores(spark, sf_dir).where("category <= 4"), "arm", "sample_id", "category")


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as audit records of the arm of their priority, with their lines as evidence."""
    evidence = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor("l_quantity").alias("token_count"))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("arm"), F.expr("if(o_orderstatus = 'P', NULL, o_orderstatus)").alias("construction_status"), F.expr("if(o_orderkey % 5 = 0, '', 'ok')").alias("status"),
        F.expr("CASE o_orderkey % 11 WHEN 0 THEN 'rank_pack' WHEN 1 THEN '' WHEN 2 THEN 'full' END").alias("fallback"), F.expr("if(o_orderkey % 7 = 0, NULL, cast(floor(o_totalprice) AS bigint))").alias("builder_tokens"), F.expr("o_orderkey % 6").alias("memory_count"),
    )
    return orders.join(report.evidence_tokens(evidence, "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and averages of each arm."""
    out = report.audit_averages(_audits(spark, sf_dir))
    return out.select("arm", "runs", "builder_tokens_known_items", *(F.round(x, 6).alias(x) for x in ("avg_evidence_tokens", "avg_builder_tokens", "avg_memory_count")))


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each arm by status and by fallback."""
    return report.audit_counts(_audits(spark, sf_dir))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with stand-in evidence: their own turn, the answer's, and one that no one knows; candidates are the turns up to them, of odd conversations up to the answer."""
    turns = blocks.turns_of(table(spark, sf_dir, "conversations"))
    questions = blocks.questions_of(table(spark, sf_dir, "conversations")).select("sample_id", "qa_id", F.expr("cast(split(qa_id, ':q')[1] AS bigint)").alias("turn"))
    dia = lambda t: f"concat('D', ({t}) div 4 + 1, ':', ({t}) % 4 + 1)"
    evidence = F.expr(f"CASE WHEN turn % 7 = 5 THEN cast(array() AS array<string>) WHEN turn % 3 = 0 THEN array({dia('turn')}, {dia('turn + 1')}, 'D99:1') ELSE array({dia('turn')}, {dia('turn + 1')}) END")
    split = F.expr("CASE WHEN cast(sample_id AS bigint) % 10 < 6 THEN 'train' WHEN cast(sample_id AS bigint) % 10 < 8 THEN 'dev' END")
    questions = questions.withColumns({"evidence": evidence, "split": split})
    near = turns.join(questions.select("sample_id", "qa_id", "turn"), "sample_id").where("turn_index <= turn + cast(sample_id AS bigint) % 2")
    candidates = near.select("qa_id", F.col("turn_index").alias("position"), F.expr("if(turn_index % 8 <> 7, dia_id, NULL)").alias("dia_id"), F.concat_ws(":", "sample_id", F.lit("x"), F.regexp_replace("dia_id", ":", "_"), F.lit("0")).alias("source_id"))
    return report.gold_counts(questions, candidates)


def split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence coverage of each split, examples joined by commas."""
    out = report.coverage(_gold(spark, sf_dir))
    return out.withColumns({"missing_examples": F.array_join("missing_examples", ","), "qa_coverage": F.round("qa_coverage", 9), "evidence_coverage": F.round("evidence_coverage", 9)})


def selected_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the training split of which all evidence is among the candidates."""
    return _gold(spark, sf_dir).where((F.col("split") == "train") & report.complete_gold()).select("qa_id", "gold", "candidates")


_AUDITS = """a AS (SELECT o_orderkey, o_orderpriority AS arm, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS construction_status, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'ok' END AS status,
  CASE o_orderkey % 11 WHEN 0 THEN 'rank_pack' WHEN 1 THEN '' WHEN 2 THEN 'full' END AS fallback, CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice)::BIGINT END AS builder_tokens, o_orderkey % 6 AS memory_count,
  (SELECT sum(floor(l_quantity)) FROM lineitem WHERE l_orderkey = o_orderkey) AS evidence_tokens FROM orders)"""
_GOLD = f"""{_TURNS}, {_QUESTIONS},
  g0 AS (SELECT sample_id, qa_id, split_part(qa_id, ':q', 2)::BIGINT AS turn FROM q),
  g1 AS (SELECT *, CASE WHEN turn % 7 = 5 THEN 0 WHEN turn % 3 = 0 THEN 3 ELSE 2 END AS gold,
    CASE WHEN sample_id::BIGINT % 10 < 6 THEN 'train' WHEN sample_id::BIGINT % 10 < 8 THEN 'dev' ELSE 'unknown' END AS split FROM g0),
  gc AS (SELECT qa_id, any_value(split) AS split, any_value(gold) AS gold, count(turn_index) AS candidates,
    count(*) FILTER (WHERE gold > 0 AND turn_index % 8 <> 7 AND (dia_id = 'D' || (g1.turn // 4 + 1) || ':' || (g1.turn % 4 + 1) OR dia_id = 'D' || ((g1.turn + 1) // 4 + 1) || ':' || ((g1.turn + 1) % 4 + 1))) AS mapped
    FROM g1 LEFT JOIN t ON t.conv_id::VARCHAR = g1.sample_id AND turn_index <= g1.turn + sample_id::BIGINT % 2 GROUP BY qa_id)"""

QUERIES = {
    "arm_report": (
        arm_report,
        "WITH f AS (" + " UNION ALL ".join(f"SELECT event_type AS arm, '{x}' AS field, {_field(i)} AS v FROM events" for i, x in enumerate(FIELDS)) + ") SELECT arm, field, round(avg(v), 6) AS avg, count(v) AS known_items, (CASE WHEN count(v) = count(*) THEN sum(v) END)::BIGINT AS total FROM f GROUP BY ALL",
    ),
    "arm_flags": (
        arm_flags,
        """SELECT event_type AS arm, count(*) FILTER (WHERE event_id % 31 <> 3) AS construction_usage_complete_items, count(*) FILTER (WHERE event_id % 3 <> 1) AS agent_usage_complete_items, count(*) FILTER (WHERE event_id % 17 = 0) AS fallback_items,
  round(avg(CASE WHEN event_id % 13 <> 5 THEN floor(value * 10) END) / 1000, 9) AS avg_agent_elapsed_seconds FROM events GROUP BY 1""",
    ),
    "report_gate": (
        report_gate,
        f"""WITH {_SCORES}, k AS (SELECT arm, sample_id, category, count(*) AS n FROM s WHERE category <= 4 GROUP BY ALL), e AS (SELECT count(*) AS expected FROM (SELECT DISTINCT sample_id, category FROM k))
SELECT arm, any_value(expected) AS expected, any_value(expected) - count(*) AS missing, sum(n - 1)::BIGINT AS repeated, any_value(expected) = count(*) AND sum(n - 1) = 0 AS complete FROM k, e GROUP BY 1""",
    ),
    "audit_summary": (
        audit_summary,
        f"""WITH {_AUDITS} SELECT arm, count(*) AS runs, count(builder_tokens) AS builder_tokens_known_items, round(avg(coalesce(evidence_tokens, 0)), 6) AS avg_evidence_tokens, round(avg(builder_tokens), 6) AS avg_builder_tokens, round(avg(memory_count), 6) AS avg_memory_count FROM a GROUP BY 1""",
    ),
    "audit_counts": (
        audit_counts,
        f"""WITH {_AUDITS} SELECT arm, 'status' AS kind, coalesce(construction_status, nullif(status, ''), 'unknown') AS name, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT arm, 'fallback', fallback, count(*) FROM a WHERE fallback <> '' GROUP BY ALL""",
    ),
    "split_coverage": (
        split_coverage,
        f"""WITH {_GOLD}, x AS (SELECT split, string_agg(qa_id, ',' ORDER BY qa_id) AS missing_examples FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY qa_id) AS r FROM gc WHERE mapped = 0) WHERE r <= 10 GROUP BY 1),
  y AS (SELECT split, count(*) AS qas, count(*) FILTER (WHERE gold > 0 AND mapped = gold) AS complete, count(*) FILTER (WHERE mapped > 0 AND mapped <> gold) AS partial, count(*) FILTER (WHERE mapped = 0) AS none, sum(gold)::BIGINT AS gold_evidence_blocks, sum(mapped)::BIGINT AS mapped_evidence_blocks FROM gc GROUP BY 1)
SELECT y.*, missing_examples, round(complete / qas::DOUBLE, 9) AS qa_coverage, round(mapped_evidence_blocks / nullif(gold_evidence_blocks, 0)::DOUBLE, 9) AS evidence_coverage FROM y LEFT JOIN x ON x.split = y.split""",
    ),
    "selected_questions": (selected_questions, f"WITH {_GOLD} SELECT qa_id, gold::BIGINT AS gold, candidates FROM gc WHERE split = 'train' AND gold > 0 AND mapped = gold"),
}
