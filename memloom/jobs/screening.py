"""Screening of units, candidate sets and vectors, and the first choice against the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.jobs import domain as j
from memloom.jobs.features import DIMENSION
from memloom.operators import domain as d
from memloom.operators import screening as s
from memloom.operators.sets import covers
from memloom.sources.tables import table

#: Units that a batch goes on with; budget of a candidate; queries of a unit, those of the probe, and the mean that it must reach.
MOST, BUDGET, ASKED, PROBED, LEAST = 12, 256, 8, 3, 0.4


def salient_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of eight conversations as a batch, one session each; terms are words of six letters or more."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    terms = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.char_length(w) >= 6)
    units = turns.select(F.expr("conv_id div 8").alias("batch"), F.col("conv_id").alias("session"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("time"), terms.alias("terms"), "text")
    return s.salient(units, MOST).select("batch", "id", "strength")


def salient_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source and a third of the ids as a batch, each hundred of ids a session, without those 0.9 like an earlier one."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").where("text IS NOT NULL")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    units = docs.select(F.concat_ws(":", "source", F.expr("doc_id % 3")).alias("batch"), F.expr("doc_id div 100").alias("session"), F.col("doc_id").alias("id"), (F.col("doc_id") % 7).alias("time"), F.filter(words, lambda w: F.char_length(w) >= 9).alias("terms"), words.alias("words"), "text")
    return s.salient(units, MOST, 0.9).select("batch", "id", "strength")


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their gate; the probe's answers are stand-ins."""
    sets = j._whole_solutions(spark, sf_dir, "ids", "prefix_costs").join(j._whole_units(spark, sf_dir).select("unit", "requirements"), "unit")
    probe = F.expr(f"aggregate(sequence(0, {PROBED - 1}), 0L, (a, q) -> a + pmod(mask % 97 * 31 + unit * 7 + q * 13, 100)) / {100 * PROBED}D")
    gate = lambda proxy: s.gate(covers(), F.col("cost"), BUDGET, proxy, LEAST, F.col("status"), d.reachable(F.lit(BUDGET)))
    return sets.withColumns({"gate": gate(probe), "would_pass": gate(F.lit(1.0)) == "admitted"}).select("unit", "mask", "more", "architecture", "gate", "would_pass")


def screening_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate at which each candidate ends."""
    return _gated(spark, sf_dir).select("unit", "mask", "more", "architecture", "gate")


def screening_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gates save and lose in each unit."""
    return s.replayed(_gated(spark, sf_dir), ASKED, PROBED, "unit", more=("more",))


def first_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the affordable solution of the highest stand-in score passes, and how much dearer than the cheapest passing one it is."""
    affordable = j._whole_solutions(spark, sf_dir).where(F.col("cost") <= BUDGET)
    key = F.expr("struct(pmod(mask % 97 * 31 + char_length(architecture) * 17 + unit, 101), ~mask, more, architecture)")
    chosen = affordable.groupBy("unit").agg(F.max_by(F.struct("mask", "more", "architecture"), key).alias("best")).select("unit", "best.*")
    return s.first_choice(chosen, affordable.where("status = 'PASS'"), "more").withColumn("excess", F.round("excess", 9))


def topic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight blocks of the vectors, by k-means."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return s.topic_blocks(rows, DIMENSION, 8).select(F.col("id").alias("vec_id"), "block")


_GATED = f"""{j._WHOLE}, {j._WHOLE_SOLUTIONS}, sized AS (SELECT sol.*, dom.prefix, EXISTS (SELECT 1 FROM p WHERE p.unit = dom.unit AND list_has_all(dom.ids, p1)) AND EXISTS (SELECT 1 FROM q WHERE q.unit = dom.unit AND list_has_all(dom.ids, p2)) AS covers,
    list_sum(list_transform(range(0, {PROBED}), lambda k: ((sol.mask % 97 * 31 + sol.unit * 7 + k * 13) % 100 + 100) % 100)) / {100 * PROBED}e0 AS probe FROM sol JOIN dom ON dom.unit = sol.unit AND dom.mask = sol.mask AND dom.more = sol.more),
  gated AS (SELECT unit, mask, more, architecture, CASE WHEN NOT covers THEN 'need' WHEN cost > {BUDGET} THEN 'budget' WHEN probe < {LEAST}::DOUBLE THEN 'proxy' WHEN status <> 'PASS' THEN lower(status) WHEN len(list_filter(prefix, lambda c: c > {BUDGET})) > 0 THEN 'unreachable' ELSE 'admitted' END AS gate,
    covers AND cost <= {BUDGET} AND status = 'PASS' AND len(list_filter(prefix, lambda c: c > {BUDGET})) = 0 AS would_pass FROM sized)"""

QUERIES = {
    "salient_units": (
        salient_units,
        f"""WITH u AS (SELECT conv_id // 8 AS batch, conv_id AS session, conv_id * 1000 + turn AS id, turn AS time, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 6) AS terms FROM conversations
    WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id // 8, text ORDER BY turn, conv_id * 1000 + turn) = 1),
  t AS (SELECT DISTINCT batch, session, id, unnest(terms) AS term FROM u), st AS (SELECT a.batch, a.id, count(DISTINCT b.session) AS strength FROM t a JOIN t b ON a.batch = b.batch AND a.term = b.term AND a.session <> b.session GROUP BY ALL),
  w AS (SELECT u.batch, session, u.id, time, coalesce(strength, 0) AS strength FROM u LEFT JOIN st ON st.batch = u.batch AND st.id = u.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY batch, session ORDER BY strength DESC, time, id) > 1 AS later FROM w)
SELECT batch, id, strength FROM r QUALIFY row_number() OVER (PARTITION BY batch ORDER BY later, strength DESC, time, id) <= {MOST}""",
    ),
    "salient_merged": (
        salient_merged,
        f"""WITH v AS (SELECT concat_ws(':', source, doc_id % 3) AS batch, doc_id // 100 AS session, doc_id AS id, doc_id % 7 AS time, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM documents
    WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY concat_ws(':', source, doc_id % 3), text ORDER BY doc_id % 7, doc_id) = 1),
  k AS (SELECT *, list_sort(list_distinct(words)) AS w FROM v), e AS (SELECT batch, id, time, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [''] ELSE w END) AS word FROM k),
  near AS (SELECT DISTINCT batch, id FROM (SELECT b.batch, b.id FROM e a JOIN e b ON a.batch = b.batch AND a.word = b.word AND row(a.time, a.id) < row(b.time, b.id) GROUP BY b.batch, b.id, a.id, a.n, b.n HAVING count(*) >= 0.9 * (greatest(a.n, 1) + greatest(b.n, 1) - count(*)) - 1e-9)),
  u AS (SELECT batch, session, id, time, list_filter(words, lambda w: length(w) >= 9) AS terms FROM v WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.batch = v.batch AND near.id = v.id)),
  t AS (SELECT DISTINCT batch, session, id, unnest(terms) AS term FROM u), st AS (SELECT a.batch, a.id, count(DISTINCT b.session) AS strength FROM t a JOIN t b ON a.batch = b.batch AND a.term = b.term AND a.session <> b.session GROUP BY ALL),
  w AS (SELECT u.batch, session, u.id, time, coalesce(strength, 0) AS strength FROM u LEFT JOIN st ON st.batch = u.batch AND st.id = u.id),
  r AS (SELECT *, row_number() OVER (PARTITION BY batch, session ORDER BY strength DESC, time, id) > 1 AS later FROM w)
SELECT batch, id, strength FROM r QUALIFY row_number() OVER (PARTITION BY batch ORDER BY later, strength DESC, time, id) <= {MOST}""",
    ),
    "screening_gates": (screening_gates, f"WITH {_GATED} SELECT unit, mask, more, architecture, gate FROM gated"),
    "screening_savings": (
        screening_savings,
        f"""WITH {_GATED}, z AS (SELECT unit, mask, more, count(*) AS pairs, count(*) FILTER (WHERE gate NOT IN ('need', 'budget')) AS probed, count(*) FILTER (WHERE gate NOT IN ('need', 'budget', 'proxy')) AS full_audits,
    count(*) FILTER (WHERE gate NOT IN ('need', 'budget', 'proxy') AND architecture = 'Flat') AS flat, count(*) FILTER (WHERE gate = 'admitted') AS admitted, count(*) FILTER (WHERE gate = 'proxy' AND would_pass) AS lost FROM gated GROUP BY ALL)
SELECT unit, sum(pairs)::BIGINT AS candidates, sum(admitted)::BIGINT AS admitted, sum(lost)::BIGINT AS lost, sum(pairs * {ASKED})::BIGINT AS evaluations_all,
  sum((probed > 0)::INT * {PROBED} + full_audits * {ASKED} - (flat > 0)::INT * {PROBED})::BIGINT AS evaluations_gated FROM z GROUP BY 1""",
    ),
    "first_choice": (
        first_choice,
        f"""WITH {j._WHOLE}, {j._WHOLE_SOLUTIONS}, ok AS (SELECT * FROM sol WHERE cost <= {BUDGET}),
  c AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY unit ORDER BY ((mask % 97 * 31 + length(architecture) * 17 + unit) % 101 + 101) % 101 DESC, mask, more DESC, architecture DESC) = 1),
  a AS (SELECT unit, min(cost) AS best, count(*) AS n FROM ok WHERE status = 'PASS' GROUP BY 1)
SELECT c.unit, mask, more, architecture, coalesce(n, 0) AS successful, status = 'PASS' AS passed, CASE WHEN status = 'PASS' THEN round((cost - best)::DOUBLE / greatest(best, 1), 9) END AS excess FROM c LEFT JOIN a ON a.unit = c.unit""",
    ),
    "topic_blocks": (topic_blocks, None),
}
