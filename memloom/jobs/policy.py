"""The selector's sequence model, candidate sources and the analytics over evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.text import SPACE_SQL, approx_tokens
from memloom.jobs import domain, retrieval
from memloom.operators import policy, state
from memloom.operators.retrieval import mean_overlap
from memloom.sources.tables import table

BUDGET = 400


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the token costs of their turns."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    items = turns.groupBy(F.col("conv_id").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("turn", approx_tokens(F.col("text")).alias("cost")))).alias("items"))
    return items.select("unit", F.size("items").alias("n"), F.col("items.cost").alias("costs"))


def _actions(sets: DataFrame) -> DataFrame:
    """Stand-in scores: later and odd ids score higher, stopping gets likelier with size."""
    logit = F.expr("0.3D * (id % 3) + 0.05D * id - 0.1D * size + 0.01D * (unit % 7)")
    return policy.action_logps(sets, logit, F.expr("0.25D * size"))


def logsumexp_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of the turns' lengths within each conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.char_length("text") / 100.0).alias("x"))
    return rows.select("conv_id", "turn", F.round(F.exp(F.col("x") - policy.logsumexp("x", "conv_id")), 9).alias("p"))


def sequence_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of ending with each reachable set."""
    sets = policy.prefixes(_units(spark, sf_dir), BUDGET)
    return policy.sequence_logps(sets, _actions(sets)).select("unit", "mask", F.round("logp", 8).alias("logp"))


def sequence_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative log mass on sets that hold the second source, and expected excess cost."""
    sets = policy.prefixes(_units(spark, sf_dir), BUDGET)
    out = policy.risk(policy.sequence_logps(sets, _actions(sets)), F.expr("(mask & 2) = 2"))
    return out.select("unit", F.round("nll", 8).alias("nll"), F.round("excess", 8).alias("excess"))


def beam_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set that a beam of 4 ends with."""
    sets = policy.prefixes(_units(spark, sf_dir), BUDGET)
    return policy.beam(_actions(sets), sets, width=4).select("unit", "mask", F.round("score", 8).alias("score"))


def exact_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most probable set of each unit, ties by smaller ids."""
    sets = policy.prefixes(_units(spark, sf_dir), BUDGET)
    scored = policy.sequence_logps(sets, _actions(sets)).withColumn("logp", F.round("logp", 8))
    return policy.best_set(scored, "logp").select("unit", "mask", "logp")


def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the last two turns of each conversation as fresh sources: those, then earlier ones by lexical score and recency."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("unit"), F.col("turn").alias("place"), F.col("turn").cast("string").alias("source_id"), "text")
    last = turns.groupBy("unit").agg(F.max("place").alias("last"))
    rows = turns.join(last, "unit").withColumn("fresh", F.expr("place > last - 2")).drop("last")
    out = state.candidate_sources(rows)
    return out.select(F.col("unit").alias("conv_id"), F.col("place").alias("turn"), F.round("overlap", 9).alias("overlap"), "id")


def evidence_overlap_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of the retrieved documents of every two questions that share some."""
    pairs = retrieval.bm25_topk(spark, sf_dir).select("question_id", "source_id")
    sizes = pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    other = pairs.select(F.col("question_id").alias("other_id"), "source_id")
    shared = pairs.join(other, "source_id").where("question_id < other_id").groupBy("question_id", "other_id").agg(F.count(F.lit(1)).alias("k"))
    shared = shared.join(sizes, "question_id").join(sizes.select(F.col("question_id").alias("other_id"), F.col("n").alias("m")), "other_id")
    return shared.select("question_id", "other_id", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 9).alias("jaccard"))


def evidence_overlap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean overlap of what the questions of a history retrieve; every eighth item is of one history."""
    rows = retrieval.bm25_topk(spark, sf_dir).select(F.expr("question_id % 8").alias("history"), "question_id", "source_id")
    return mean_overlap(rows, "history").withColumn("mean_jaccard", F.round("mean_jaccard", 9))


def covcore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark item with evidence: whether all of it was retrieved, and how much."""
    evidence = retrieval.evidence(spark, sf_dir)
    top = retrieval.bm25_topk(spark, sf_dir).select("question_id", "source_id", F.lit(1).alias("hit"))
    found = evidence.join(top, ["question_id", "source_id"], "left").groupBy("question_id").agg(F.count(F.lit(1)).alias("evidence"), F.count("hit").alias("found"))
    return found.withColumn("covered", F.col("evidence") == F.col("found"))


def evidence_pairs_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (benchmark item, document that holds it)."""
    return retrieval.evidence(spark, sf_dir)


def beneficial_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between neighbouring budgets of a unit: whether the larger one passes where the smaller doesn't, or passes for less."""
    archive = domain.budget_archive(spark, sf_dir)
    bound = domain.cost_bounds(spark, sf_dir).select("unit", "budget", "upper")
    rows = archive.join(bound, ["unit", "budget"])
    by = Window.partitionBy("unit").orderBy("budget")
    moved = rows.withColumns({"before": F.lag("upper").over(by), "had": F.lag("budget").over(by)})
    kind = F.when(F.col("upper").isNull(), "none").when(F.col("before").isNull(), "gained").when(F.col("upper") < F.col("before"), "cheaper").otherwise("same")
    return moved.where("had IS NOT NULL").select("unit", "budget", kind.alias("switch"))


_WORDS = f"list_filter(string_split_regex(text, '{SPACE_SQL}'), lambda w: w <> '')"
_LOGPS = f"""
  u AS (SELECT conv_id AS unit, count(*) AS n, list(greatest(1, ceil(len({_WORDS}) * 1.3e0))::BIGINT ORDER BY turn) AS costs FROM conversations GROUP BY 1),
  sets AS (SELECT *, list_filter(range(1, n + 1), lambda k: (mask >> (k - 1)) & 1 = 1) AS ids FROM (SELECT *, unnest(range(0, 1::BIGINT << n)) AS mask FROM u)),
  ok AS (SELECT unit, n, mask, ids, len(ids) AS size, cost FROM (SELECT *, coalesce(list_sum(list_transform(ids, lambda k: costs[k])), 0)::BIGINT AS cost FROM sets) WHERE cost <= {BUDGET}),
  act AS (
    SELECT unit, mask - (1::BIGINT << (ids[len(ids)] - 1)) AS mask, ids[len(ids)] AS id, 3e-1 * (ids[len(ids)] % 3) + 5e-2 * ids[len(ids)] - 1e-1 * (size - 1) + 1e-2 * (unit % 7) AS logit FROM ok WHERE mask <> 0
    UNION ALL SELECT unit, mask, 0, 25e-2 * size FROM ok),
  lp AS (SELECT unit, mask, id, logit - ln(sum(exp(logit)) OVER (PARTITION BY unit, mask)) AS logp FROM act),
  steps AS (SELECT unit, mask AS terminal, cost, 0 AS id, mask AS mask FROM ok UNION ALL SELECT unit, mask, cost, k, mask & ((1::BIGINT << (k - 1)) - 1) FROM (SELECT *, unnest(ids) AS k FROM ok)),
  seq AS (SELECT steps.unit, terminal AS mask, any_value(cost) AS cost, sum(logp) AS logp FROM steps JOIN lp ON lp.unit = steps.unit AND lp.mask = steps.mask AND lp.id = steps.id GROUP BY ALL)"""
#: Ids in a mask, in an expression of each.
_IDS = "list_transform(list_filter(range(1, 65), lambda k: ({m} >> (k - 1)) & 1 = 1), lambda k: {x})"
_EVIDENCE = "ev AS (SELECT item_id AS question_id, doc_id AS source_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"

QUERIES = {
    "logsumexp_softmax": (logsumexp_softmax, "SELECT conv_id, turn, round(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY conv_id), 9) AS p FROM (SELECT *, max(x) OVER (PARTITION BY conv_id) AS m FROM (SELECT conv_id, turn, length(text) / 1e2 AS x FROM conversations))"),
    "sequence_logps": (sequence_logps, f"WITH {_LOGPS} SELECT unit, mask, round(logp, 8) AS logp FROM seq"),
    "sequence_risk": (
        sequence_risk,
        f"""WITH {_LOGPS}, g AS (SELECT unit, cost, exp(logp) AS m, min(cost) OVER (PARTITION BY unit) AS best FROM seq WHERE (mask & 2) = 2)
SELECT unit, round(-ln(sum(m)), 8) AS nll, round(sum(m * (cost - best) / greatest(best, 1)) / sum(m), 8) AS excess FROM g GROUP BY 1""",
    ),
    "beam_decode": (
        beam_decode,
        f"""WITH RECURSIVE {_LOGPS},
  grow AS (SELECT unit, mask, mask | (1::BIGINT << (id - 1)) AS next, logp FROM lp WHERE id > 0),
  beam AS (
    SELECT unit, 0::BIGINT AS mask, 0e0 AS score FROM u
    UNION ALL
    SELECT unit, mask, score FROM (
      SELECT beam.unit, next AS mask, score + logp AS score, row_number() OVER (PARTITION BY beam.unit ORDER BY round(score + logp, 9) DESC, {_IDS.format(m='next', x='k')}) AS r
      FROM beam JOIN grow ON grow.unit = beam.unit AND grow.mask = beam.mask) WHERE r <= 4),
  ended AS (SELECT beam.unit, beam.mask, score + logp AS score FROM beam JOIN lp ON lp.unit = beam.unit AND lp.mask = beam.mask AND id = 0)
SELECT unit, mask, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(score, 9) DESC, {_IDS.format(m='mask', x='-k')} DESC) AS r FROM ended) WHERE r = 1""",
    ),
    "exact_decode": (exact_decode, f"WITH {_LOGPS} SELECT unit, mask, logp FROM (SELECT unit, mask, round(logp, 8) AS logp, row_number() OVER (PARTITION BY unit ORDER BY round(logp, 8) DESC, {_IDS.format(m='mask', x='-k')} DESC) AS r FROM seq) WHERE r = 1"),
    "candidate_sources": (
        candidate_sources,
        """WITH t AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tokens, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
  a AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn)), '[a-z0-9]+')) AS asked FROM t WHERE turn > last - 2 GROUP BY 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY overlap DESC, turn DESC) AS r FROM (SELECT t.conv_id, turn, len(list_intersect(tokens, asked)) / sqrt((greatest(1, len(asked)) * greatest(1, len(tokens)))::DOUBLE) AS overlap FROM t JOIN a ON a.conv_id = t.conv_id WHERE turn <= last - 2)),
  b AS (SELECT conv_id, turn, 0 AS part, turn AS pos, NULL::DOUBLE AS overlap FROM t WHERE turn > last - 2 UNION ALL SELECT conv_id, turn, 1, r, overlap FROM o WHERE r <= 16)
SELECT conv_id, turn, round(overlap, 9) AS overlap, id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS id FROM b) WHERE id <= 64""",
    ),
    "evidence_pairs": (evidence_pairs_found, f"WITH {_EVIDENCE} SELECT * FROM ev"),
    "evidence_overlap_jaccard": (
        evidence_overlap_jaccard,
        f"""WITH {retrieval.TOP5_SQL}, n AS (SELECT question_id, count(*) AS n FROM top GROUP BY 1),
  k AS (SELECT a.question_id, b.question_id AS other_id, count(*) AS k FROM top a JOIN top b ON a.source_id = b.source_id AND a.question_id < b.question_id GROUP BY ALL)
SELECT k.question_id, other_id, round(k::DOUBLE / (x.n + y.n - k), 9) AS jaccard FROM k JOIN n x ON x.question_id = k.question_id JOIN n y ON y.question_id = other_id""",
    ),
    "evidence_overlap_mean": (
        evidence_overlap_mean,
        f"""WITH {retrieval.TOP5_SQL}, n AS (SELECT question_id % 8 AS history, question_id, count(*) AS n FROM top GROUP BY ALL), c AS (SELECT history, count(*) AS questions FROM n GROUP BY 1),
  k AS (SELECT a.question_id % 8 AS history, a.question_id AS x, b.question_id AS y, count(*) AS k FROM top a JOIN top b ON a.source_id = b.source_id AND a.question_id % 8 = b.question_id % 8 AND a.question_id < b.question_id GROUP BY ALL),
  j AS (SELECT k.history, sum(k::DOUBLE / (p.n + q.n - k)) AS total FROM k JOIN n p ON p.question_id = x JOIN n q ON q.question_id = y GROUP BY 1)
SELECT c.history, questions, questions * (questions - 1) // 2 AS pairs, CASE WHEN questions > 1 THEN round(coalesce(total, 0) / (questions * (questions - 1) // 2), 9) END AS mean_jaccard FROM c LEFT JOIN j ON j.history = c.history""",
    ),
    "covcore": (
        covcore,
        f"""WITH {retrieval.TOP5_SQL}, {_EVIDENCE}, g AS (SELECT question_id, count(*) AS evidence, count(t.source_id) AS found FROM ev LEFT JOIN top t USING (question_id, source_id) GROUP BY 1)
SELECT *, evidence = found AS covered FROM g""",
    ),
    "beneficial_switch": (
        beneficial_switch,
        f"""WITH {domain._WHOLE}, b AS (SELECT unit, budget, min(cost) FILTER (WHERE status = 'PASS') AS upper FROM ev GROUP BY ALL),
  l AS (SELECT *, lag(upper) OVER w AS before, lag(budget) OVER w AS had FROM b WINDOW w AS (PARTITION BY unit ORDER BY budget))
SELECT unit, budget, CASE WHEN upper IS NULL THEN 'none' WHEN before IS NULL THEN 'gained' WHEN upper < before THEN 'cheaper' ELSE 'same' END AS switch FROM l WHERE had IS NOT NULL""",
    ),
}
