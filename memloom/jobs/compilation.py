"""Exact costs of builder inputs, domains by these costs, and their evaluation in rounds: a conversation is a unit, its turns are the sources."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.jobs import domain as base
from memloom.operators import compilation, pricing, policy
from memloom.operators import domain as d
from memloom.operators.builder import MAX_ITEMS, SYSTEM
from memloom.sources.scratch import materialize
from memloom.sources.tables import table

INPUT_LIMIT, BUDGET = 1100, 620


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.struct((F.col("turn") + 1).cast("int").alias("id"), F.concat_ws(":", "conv_id", "turn").alias("source_id"), F.expr("if(turn % 5 = 4, NULL, concat('s', turn div 3))").alias("session"), F.col("role").alias("speaker"), F.lit(None).cast("string").alias("time"), F.col("turn").alias("position"), F.lit(None).cast("int").alias("source_offset"), "text")
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "unit").withColumn("conv_id", F.col("unit"))
    out = turns.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.collect_list(source).alias("sources"))
    return out.where(F.col("n") <= d.MOST)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every unit under two architectures."""
    units = base._units(spark, sf_dir)
    bases = d.bases(units)
    sets = d.candidates(bases, d.context(bases, base._sources(spark, sf_dir)), base.SHORTLIST, units)
    return sets.select("unit", "n", "mask", F.explode(F.array(*map(F.lit, pricing.CONTRACTS))).alias("architecture"))


def _domain(spark: SparkSession, sf_dir: str, count=pricing.by_bytes, limit: int = INPUT_LIMIT, parts: bool = False) -> DataFrame:
    priced, _ = pricing.with_costs(_sets(spark, sf_dir), _sources(spark, sf_dir), count, parts=parts)
    return materialize(pricing.capped(priced, limit, *pricing.KEYS), "domain")


def exact_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of each unit and architecture within the cap, with what their input and the dearest of its prefixes cost."""
    return _domain(spark, sf_dir).select(*pricing.KEYS, "mask", "cost", "reach")


def exact_domain_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, counted by a tokenizer."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return _domain(spark, sf_dir, pricing.by_tokenizer(definition), 8192, pricing.adds_up(definition)).select(*pricing.KEYS, "mask", "cost", "reach")


def _audited(rows: DataFrame) -> DataFrame:
    """Stand-in for building and auditing."""
    return rows.withColumn("status", F.expr("CASE pmod(mask % 11 * 5 + unit + length(architecture), 7) WHEN 0 THEN 'PASS' WHEN 1 THEN 'UNKNOWN' ELSE 'FAIL' END"))


def _compiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sets = _domain(spark, sf_dir).withColumn("reached", F.col("reach") <= BUDGET)
    return sets, compilation.compile_domain(sets, _audited, *pricing.KEYS)


def compile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets that were evaluated, in order, until nothing cheaper could pass."""
    return _compiled(spark, sf_dir)[1].select(*pricing.KEYS, "mask", "place", "status")


def compile_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost bounds of every unit and architecture, and how many evaluations they took."""
    return compilation.certificate(*_compiled(spark, sf_dir), *pricing.KEYS)


def exact_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every set of a unit's sources that a budget reaches at exact cost, grown source by source."""
    sources = _sources(spark, sf_dir)

    def price(grown: DataFrame) -> DataFrame:
        rows = grown.drop("cost").withColumn("architecture", F.lit("Flat"))
        return rows.join(pricing.by_bytes(pricing.prompts(rows.select(*pricing.KEYS, "mask"), sources)), [*pricing.KEYS, "mask"]).drop("architecture")

    return policy.prefixes(sources.select("unit", "n"), BUDGET, price).select("unit", "mask", "cost")


def _prompt(sets: str) -> str:
    """DuckDB SQL of costs: ``unit, architecture, mask, cost`` of the rows of ``sets`` that aren't empty."""
    before, after = (x.replace("'", "''") for x in pricing.INSTRUCTION.split("{architecture}"))
    piece = """'{"id":' || (turn + 1) || ',"position":' || turn || ',"session":' || CASE WHEN turn % 5 = 4 THEN 'null' ELSE '"s' || turn // 3 || '"' END || ',"source_id":"' || conv_id || ':' || turn || '","source_offset":null,"speaker":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"text":' || to_json(coalesce(text, ''))::VARCHAR || ',"time":null}'"""
    return f"""SELECT unit, architecture, mask, ((strlen('{before}' || architecture || '{after}' || chr(10) || '{{"architecture":"' || architecture || '","architecture_contract":"' || CASE architecture WHEN 'Flat' THEN '{pricing.CONTRACTS['Flat']}' ELSE '{pricing.CONTRACTS['Chain']}' END ||
      '","output":{{"item":{{"m":"string","src":"integer[]"}},"max_items":{MAX_ITEMS},"type":"array"}},"schema":"memory-1","sources":[' || string_agg(piece, ',' ORDER BY turn) || '],"structure":{{"architecture":"' || architecture || '","edges":[' ||
      CASE architecture WHEN 'Flat' THEN '' ELSE coalesce(string_agg('[' || before || ',' || (turn + 1) || ']', ',' ORDER BY turn) FILTER (before IS NOT NULL), '') END || '],"groups":[' || CASE architecture WHEN 'Flat' THEN '[' || string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) || ']' ELSE '' END ||
      '],"nodes":[' || string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) || ']}},"system":"{SYSTEM}","write_stage":true}}') + 3) // 4)::BIGINT AS cost
    FROM (SELECT x.*, c.turn, {piece} AS piece, lag(c.turn + 1) OVER (PARTITION BY x.unit, architecture, mask ORDER BY c.turn) AS before FROM {sets} x JOIN conversations c ON c.conv_id = x.unit AND (mask >> c.turn) & 1 = 1) GROUP BY unit, architecture, mask"""


_EXACT = f"""{base._DOMAIN},
  cand AS (SELECT unit, n, mask, unnest(['Flat', 'Chain']) AS architecture FROM best),
  pre AS (SELECT unit, architecture, mask, unnest(CASE WHEN mask = 0 THEN [0] ELSE list_transform(list_filter(range(1, n + 1), lambda k: (mask >> (k - 1)) & 1 = 1), lambda k: mask & ((1::BIGINT << k) - 1)) END)::BIGINT AS prefix FROM cand),
  asked AS (SELECT DISTINCT unit, architecture, prefix AS mask FROM pre),
  cost AS (SELECT unit, architecture, mask, 0::BIGINT AS cost FROM asked WHERE mask = 0 UNION ALL {_prompt("(SELECT * FROM asked WHERE mask <> 0)")}),
  reach AS (SELECT pre.unit, pre.architecture, pre.mask, max(cost) AS reach FROM pre JOIN cost ON cost.unit = pre.unit AND cost.architecture = pre.architecture AND cost.mask = prefix GROUP BY ALL),
  priced2 AS (SELECT cand.*, cost, reach FROM cand JOIN cost ON cost.unit = cand.unit AND cost.architecture = cand.architecture AND cost.mask = cand.mask JOIN reach ON reach.unit = cand.unit AND reach.architecture = cand.architecture AND reach.mask = cand.mask),
  ful AS (SELECT unit, architecture, cost AS full_cost FROM priced2 WHERE mask = (1::BIGINT << n) - 1),
  exact AS (SELECT p.*, p.reach <= {BUDGET} AS reached FROM priced2 p JOIN ful ON ful.unit = p.unit AND ful.architecture = p.architecture WHERE full_cost <= {INPUT_LIMIT} AND p.cost <= full_cost)"""
_RECORDS = f"""{_EXACT},
  st AS (SELECT *, CASE (mask % 11 * 5 + unit + length(architecture)) % 7 WHEN 0 THEN 'PASS' WHEN 1 THEN 'UNKNOWN' ELSE 'FAIL' END AS status,
    row_number() OVER (PARTITION BY unit, architecture ORDER BY mask <> (1::BIGINT << n) - 1, cost, list_filter(range(1, n + 1), lambda k: (mask >> (k - 1)) & 1 = 1)) AS place FROM exact WHERE reached OR mask = (1::BIGINT << n) - 1),
  bst AS (SELECT *, min(CASE WHEN status = 'PASS' AND reached THEN cost END) OVER (PARTITION BY unit, architecture ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM st),
  rec AS (SELECT * FROM bst WHERE known IS NULL OR cost < known)"""

QUERIES = {
    "exact_domain": (exact_domain, f"WITH {_EXACT} SELECT unit, architecture, mask, cost, reach FROM exact"),
    "exact_domain_bpe": (exact_domain_bpe, None),
    "compile_records": (compile_records, f"WITH {_RECORDS} SELECT unit, architecture, mask, place, status FROM rec"),
    "compile_certificate": (
        compile_certificate,
        f"""WITH {_RECORDS}, v AS (SELECT e.unit, e.architecture, e.mask, e.cost, rec.status FROM exact e LEFT JOIN rec ON rec.unit = e.unit AND rec.architecture = e.architecture AND rec.mask = e.mask WHERE e.reached),
  b AS (SELECT unit, architecture, min(cost) FILTER (WHERE status IS DISTINCT FROM 'FAIL') AS lower, min(cost) FILTER (WHERE status = 'PASS') AS upper, count(*) FILTER (WHERE status IS NULL) AS unseen, count(*) FILTER (WHERE status = 'UNKNOWN') AS unknown FROM v GROUP BY ALL)
SELECT b.*, upper - lower AS gap, coalesce(upper = lower, false) AS closed, evaluations FROM b JOIN (SELECT unit, architecture, count(*) AS evaluations FROM rec GROUP BY ALL) c ON c.unit = b.unit AND c.architecture = b.architecture""",
    ),
    "exact_prefixes": (
        exact_prefixes,
        f"""WITH u AS (SELECT conv_id AS unit, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) <= {d.MOST}),
  every AS (SELECT unit, 'Flat' AS architecture, unnest(range(1, 1::BIGINT << n)) AS mask FROM u),
  cost AS ({_prompt("every")})
SELECT unit, 0::BIGINT AS mask, 0::BIGINT AS cost FROM u UNION ALL
SELECT unit, mask, cost FROM cost a WHERE cost <= {BUDGET} AND NOT EXISTS (SELECT 1 FROM cost b WHERE b.unit = a.unit AND b.cost > {BUDGET} AND b.mask < a.mask AND (a.mask & b.mask) = b.mask AND a.mask % (1::BIGINT << (1 + log2(b.mask)::BIGINT)) = b.mask)""",
    ),
}
