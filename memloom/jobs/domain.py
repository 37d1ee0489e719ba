"""Candidate domains and certification: a conversation is a unit, its turns are the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import SPACE_SQL, approx_tokens
from memloom.operators import certify, pricing, sets
from memloom.operators import domain as d
from memloom.operators.structure import ARCHITECTURES
from memloom.sources.tables import table

SHORTLIST, LIMIT, BUDGETS = 8, 1200, (128, 256, 512)
#: Stand-in audit of a set.
STATUS = "CASE pmod(mask % 5 * 7 + unit, 5) WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'FAIL' END"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.when(F.col("turn") % 5 != 4, F.expr("turn div 3"))
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("unit"), (F.col("turn") + 1).alias("id"), session.alias("session"), F.col("turn").alias("position"), (F.col("turn") * 7 % 5).alias("score"), approx_tokens(F.col("text")).alias("cost"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of sources of every unit, of any size."""
    return _sources(spark, sf_dir).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of at most 64 sources with two requirements of two packages each; for the others see ``unit_status``."""
    n = _sizes(spark, sf_dir).where(F.col("n") <= d.MOST)
    return n.withColumn("requirements", F.expr("array(array(1L, if(n > 1, 2L, 1L)), array(if(n > 1, 2L, 1L) | shiftleft(1L, int(n - 1)), 1L | if(n > 2, 4L, 1L)))"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _sources(spark, sf_dir).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("id", "cost"))).alias("items"))
    return items.select("unit", F.col("items.cost").alias("costs"))


def _domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark, sf_dir)
    bases = d.bases(units)
    sets = d.candidates(bases, d.context(bases, _sources(spark, sf_dir)), SHORTLIST, units)
    return pricing.capped(d.with_cost(sets, _costs(spark, sf_dir)), LIMIT, "unit")


def _whole_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of any size with two requirements of two packages each, as ids."""
    return _sizes(spark, sf_dir).withColumn("requirements", F.expr("array(array(array(1L), array(if(n > 1, 2L, 1L))), array(array_distinct(array(if(n > 1, 2L, 1L), n)), array_distinct(array(1L, if(n > 2, 3L, 1L)))))"))


def _whole_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets of all units: of any number of sources and at any cost."""
    units = _whole_units(spark, sf_dir)
    bases = sets.bases(units)
    made = sets.candidates(bases, d.context(bases, _sources(spark, sf_dir), sets.HOLDS), SHORTLIST, units)
    return d.with_cost(made, _costs(spark, sf_dir), "ids")


def _whole_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets of all units with the stand-in audit, at each budget that reaches a set."""
    budgets = F.explode(F.array(*(F.lit(b).cast("long") for b in BUDGETS))).alias("budget")
    return _whole_domain(spark, sf_dir).withColumn("status", F.expr(STATUS)).select("*", budgets).where(d.reachable(F.col("budget")))


def unit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which units have a domain, and why others have none."""
    full = _sources(spark, sf_dir).groupBy("unit").agg((F.sum("cost") + F.when(F.count(F.lit(1)) == 1, d.SINGLE).otherwise(0)).alias("full_cost"))
    return d.unit_status(_sizes(spark, sf_dir), full, LIMIT)


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain with a stand-in audit by mask, at each budget that reaches a set."""
    budgets = F.explode(F.array(*(F.lit(b).cast("long") for b in BUDGETS))).alias("budget")
    return _domain(spark, sf_dir).withColumn("status", F.expr(STATUS)).select("*", budgets).where(d.reachable(F.col("budget")))


def package_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of every unit."""
    return d.bases(_units(spark, sf_dir)).select("unit", "base")


def context_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of the sources outside each base."""
    return d.context(d.bases(_units(spark, sf_dir)), _sources(spark, sf_dir)).select("unit", "base", "id", "place")


def candidate_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets within the cost limit, with the first way to make them."""
    return _domain(spark, sf_dir).select("unit", "mask", "kind", "base", "cost")


def prefix_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sets each budget reaches; ``more`` names ids over 64."""
    return _whole_evaluated(spark, sf_dir).select("unit", "mask", "more", "budget")


def cost_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on the cheapest passing set of each unit and budget."""
    return d.bounds(_whole_evaluated(spark, sf_dir), "unit", "budget")


def budget_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per unit and budget: reachable and passing sets, and the cheapest passing one (ties by ids)."""
    best = F.min(F.when(F.col("status") == "PASS", F.struct("cost", "ids", "mask", "more")))
    out = _whole_evaluated(spark, sf_dir).groupBy("unit", "budget").agg(F.count(F.lit(1)).alias("reachable"), F.count_if(F.col("status") == "PASS").alias("successful"), best.alias("best"))
    return out.select("unit", "budget", "reachable", "successful", F.col("best.mask").alias("best_mask"), F.col("best.more").alias("best_more"))


def form_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each set holds a package of every requirement."""
    return _whole_domain(spark, sf_dir).join(_whole_units(spark, sf_dir).drop("n"), "unit").select("unit", "mask", "more", sets.covers().alias("covers"))


def evaluation_order(spark: SparkSession, sf_dir: str, most: int = 16) -> DataFrame:
    """The first sets of each unit in the order of their evaluation: the full set, then by cost and ids."""
    return d.evaluation_order(_whole_domain(spark, sf_dir), most, "size(ids) <> n", "ids").select("unit", "mask", "more", "place")


def _solutions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Evaluated sets under each architecture, whose structure costs ``index * size`` more, with a stand-in audit and columns of the domain."""
    return _structured(_domain(spark, sf_dir).withColumn("size", F.bit_count("mask")), *more)


def _whole_solutions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The same for all sets of all units."""
    return _structured(_whole_domain(spark, sf_dir).withColumn("size", F.size("ids")), "more", *more)


def _structured(rows: DataFrame, *more: str) -> DataFrame:
    index = F.explode(F.array(*(F.lit(i) for i in range(len(ARCHITECTURES))))).alias("g")
    rows = rows.select("unit", "mask", "cost", "size", *more, index).withColumn("architecture", F.element_at(F.array(*map(F.lit, ARCHITECTURES)), F.col("g") + 1))
    status = F.expr("CASE pmod(mask % 5 * 7 + unit + g * 3, 4) WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'UNKNOWN' ELSE 'PASS' END")
    return rows.select("unit", "mask", "architecture", F.expr("cost + g * size * 9").alias("cost"), status.alias("status"), *more)


def conservative_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of each set under its dearest architecture, and the architectures that a budget of 256 leaves it."""
    return d.architecture_choice(_whole_solutions(spark, sf_dir), 256, "more").withColumn("feasible", F.array_join("feasible", ","))


def architecture_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per unit: sets for which some architecture is better than Flat, the mean gain in utility, and the best gain."""
    gains = d.architecture_gain(_whole_solutions(spark, sf_dir), "more")
    return gains.groupBy("unit").agg(F.count_if(F.col("gain") > 0).alias("better"), F.round(F.avg("gain"), 9).alias("mean_gain"), F.max("gain").alias("best_gain"))


def solution_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint positive labels of each unit: the passing solutions of two archives, each once, the first archive's before the other's."""
    old = _solutions(spark, sf_dir).where("status = 'PASS' AND cost <= 256").withColumn("archive", F.lit(1))
    new = _solutions(spark, sf_dir).where("status = 'PASS' AND cost > 128").withColumn("archive", F.lit(2))
    return d.first_of_archives(old.unionByName(new)).select("unit", "architecture", "mask", "cost", F.col("archive").cast("long").alias("archive"))


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per unit and budget: labels (cheap sets with a stand-in mark), those among them that never passed, and whether the row can train."""
    rows = _whole_evaluated(spark, sf_dir).withColumn("label", F.expr("pmod(mask % 3 + unit, 3) = 0 AND status IN ('PASS', 'UNKNOWN') AND (status = 'PASS' OR unit % 4 = 0)"))
    return d.label_check(rows, "unit", "budget")


def train_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty usable training rows by budget and unit; their labels are sets that passed."""
    rows = _evaluated(spark, sf_dir).withColumn("label", F.expr("pmod(mask + unit, 3) = 0 AND coalesce(status, '') = 'PASS'"))
    return d.train_selection(d.label_check(rows, "unit", "budget"), ["budget", "unit"], 40).select("unit", "budget", "labels")


def archive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of what neighbouring budgets let pass."""
    passing = _whole_evaluated(spark, sf_dir).where("status = 'PASS'").select("unit", "mask", "more", "budget")
    flags = passing.groupBy("unit", "mask", "more").agg(*(F.max((F.col("budget") == b).cast("int")).alias(f"b{b}") for b in BUDGETS))
    shared = lambda a, b: F.sum(F.col(f"b{a}") * F.col(f"b{b}")) / F.nullif(F.sum(F.greatest(f"b{a}", f"b{b}")), F.lit(0))
    return flags.groupBy("unit").agg(F.round(shared(128, 256), 9).alias("j_128_256"), F.round(shared(256, 512), 9).alias("j_256_512"))


def tri_state_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three audits of every document and their worst; a document without a label is unknown."""
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    source = certify.verdict(F.col("quality") == 1, F.col("quality") == 0)
    needs = certify.verdict(F.col("toxic") == 0, F.col("toxic") == 1)
    form = certify.verdict(F.col("n_chars") > 0, F.col("n_chars") <= 0)
    return docs.select("doc_id", source.alias("source_audit"), needs.alias("requirement_audit"), form.alias("structure_audit")).withColumn("status", certify.worst(F.col("source_audit"), F.col("requirement_audit"), F.col("structure_audit")))


def utility_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility, coverage and lifecycle cost of every unit, and whether both thresholds are met."""
    rows = _sources(spark, sf_dir).withColumns({"q": F.expr("(unit * 13 + id * 29) % 100 / 100D"), "usage": F.expr("if(unit % 7 = 0 AND id = 2, NULL, cost)")})
    out = rows.groupBy("unit").agg(F.round(F.avg("q"), 9).alias("utility"), F.round(F.avg((F.col("q") >= 0.4).cast("double")), 9).alias("coverage"), F.round(certify.guarded_sum(F.col("usage")) / F.count(F.lit(1)), 9).alias("lifecycle_cost"))
    return out.withColumn("status", F.when((F.col("utility") >= 0.4) & (F.col("coverage") >= 0.5), "PASS").otherwise("FAIL"))


_WORDS = f"list_filter(string_split_regex(text, '{SPACE_SQL}'), lambda w: w <> '')"
_DOMAIN = f"""
  s AS (SELECT conv_id AS unit, turn + 1 AS id, CASE WHEN turn % 5 <> 4 THEN turn // 3 END AS session, turn AS position, turn * 7 % 5 AS score, greatest(1, ceil(len({_WORDS}) * 1.3e0))::BIGINT AS cost FROM conversations),
  u AS (SELECT unit, count(*) AS n, list(cost ORDER BY id) AS costs FROM s GROUP BY 1 HAVING count(*) <= {d.MOST}),
  p AS (SELECT unit, n, unnest([1, CASE WHEN n > 1 THEN 2 ELSE 1 END])::BIGINT AS p1 FROM u),
  q AS (SELECT unit, unnest([(CASE WHEN n > 1 THEN 2 ELSE 1 END) | (1::BIGINT << (n - 1)), 1 | (CASE WHEN n > 2 THEN 4 ELSE 1 END)])::BIGINT AS p2 FROM u),
  bases AS (SELECT DISTINCT unit, n, p1 | p2 AS base FROM p JOIN q USING (unit)),
  e AS (SELECT b.unit, n, base, s.id, s.session, s.position, s.score FROM bases b JOIN s USING (unit) WHERE (base >> (s.id - 1)) & 1 = 0),
  i AS (SELECT b.unit, base, s.session, s.position FROM bases b JOIN s USING (unit) WHERE (base >> (s.id - 1)) & 1 = 1),
  o AS (SELECT unit, n, base, id, row_number() OVER (PARTITION BY unit, base ORDER BY dist IS NULL, dist, score DESC, id) AS place
    FROM (SELECT e.*, (SELECT min(abs(e.position - i.position)) FROM i WHERE i.unit = e.unit AND i.base = e.base AND i.session = e.session) AS dist FROM e)),
  sl AS (SELECT b.unit, b.n, b.base, coalesce(list((1::BIGINT << (id - 1)) ORDER BY id) FILTER (WHERE place <= {SHORTLIST}), []) AS bits FROM bases b LEFT JOIN o USING (unit, base) GROUP BY ALL),
  made AS (
    SELECT DISTINCT unit, n, (1::BIGINT << n) - 1 AS mask, 1 AS priority, (1::BIGINT << n) - 1 AS base FROM bases
    UNION ALL SELECT unit, n, base | coalesce(list_sum(list_transform(range(1, len(bits) + 1), lambda k: CASE WHEN (pick >> (k - 1)) & 1 = 1 THEN bits[k] ELSE 0 END)), 0)::BIGINT, 2, base FROM (SELECT *, unnest(range(0, 1::BIGINT << len(bits))) AS pick FROM sl)
    UNION ALL SELECT b.unit, n, base | (((1::BIGINT << n) - 1) & ~support), 3, base FROM bases b JOIN (SELECT unit, bit_or(m) AS support FROM (SELECT unit, p1 AS m FROM p UNION ALL SELECT unit, p2 FROM q) GROUP BY 1) x ON x.unit = b.unit),
  best AS (SELECT unit, n, mask, min(row(priority > 1, list_filter(range(1, n + 1), lambda k: (base >> (k - 1)) & 1 = 1), priority, base)) AS w FROM made GROUP BY ALL),
  priced AS (SELECT best.unit, best.n, mask, w[3] AS priority, w[4] AS base, list_filter(range(1, best.n + 1), lambda k: (mask >> (k - 1)) & 1 = 1) AS ids, costs FROM best JOIN u USING (unit)),
  pc AS (SELECT *, list_transform(range(1, len(ids) + 1), lambda k: list_sum(list_transform(ids[1:k], lambda j: costs[j])) + CASE WHEN k = 1 THEN {d.SINGLE} ELSE 0 END) AS prefix FROM priced),
  fc AS (SELECT unit, (list_sum(costs) + CASE WHEN n = 1 THEN {d.SINGLE} ELSE 0 END)::BIGINT AS full_cost FROM u),
  dom AS (SELECT pc.*, coalesce(prefix[len(prefix)], 0)::BIGINT AS cost FROM pc JOIN fc ON fc.unit = pc.unit WHERE full_cost <= {LIMIT} AND coalesce(prefix[len(prefix)], 0) <= full_cost),
  ev AS (SELECT *, CASE (mask * 7 + unit) % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'FAIL' END AS status
    FROM (SELECT *, unnest({list(BUDGETS)})::BIGINT AS budget FROM dom) WHERE len(list_filter(prefix, lambda c: c > budget)) = 0)"""

#: All sets of all units, as lists of ids.
_WHOLE = f"""
  s AS (SELECT conv_id AS unit, turn + 1 AS id, CASE WHEN turn % 5 <> 4 THEN turn // 3 END AS session, turn AS position, turn * 7 % 5 AS score, greatest(1, ceil(len({_WORDS}) * 1.3e0))::BIGINT AS cost FROM conversations),
  u AS (SELECT unit, count(*) AS n, list(cost ORDER BY id) AS costs FROM s GROUP BY 1),
  p AS (SELECT unit, n, unnest([[1], [CASE WHEN n > 1 THEN 2 ELSE 1 END]])::BIGINT[] AS p1 FROM u),
  q AS (SELECT unit, unnest([[CASE WHEN n > 1 THEN 2 ELSE 1 END, n], [1, CASE WHEN n > 2 THEN 3 ELSE 1 END]])::BIGINT[] AS p2 FROM u),
  bases AS (SELECT DISTINCT unit, n, list_sort(list_distinct(p1 || p2)) AS base FROM p JOIN q USING (unit)),
  e AS (SELECT b.unit, n, base, s.id, s.session, s.position, s.score FROM bases b JOIN s USING (unit) WHERE NOT list_contains(base, s.id)),
  i AS (SELECT b.unit, base, s.session, s.position FROM bases b JOIN s USING (unit) WHERE list_contains(base, s.id)),
  o AS (SELECT unit, n, base, id, row_number() OVER (PARTITION BY unit, base ORDER BY dist IS NULL, dist, score DESC, id) AS place
    FROM (SELECT e.unit, e.n, e.base, e.id, e.score, min(abs(e.position - i.position)) AS dist FROM e LEFT JOIN i ON i.unit = e.unit AND i.base = e.base AND i.session = e.session GROUP BY ALL)),
  sl AS (SELECT b.unit, b.n, b.base, coalesce(list(id ORDER BY id) FILTER (WHERE place <= {SHORTLIST}), []) AS extras FROM bases b LEFT JOIN o USING (unit, base) GROUP BY ALL),
  made AS (
    SELECT unit, n, range(1, n + 1) AS ids FROM u
    UNION SELECT unit, n, list_sort(base || list_transform(list_filter(range(1, len(extras) + 1), lambda k: (pick >> (k - 1)) & 1 = 1), lambda k: extras[k])) FROM (SELECT *, unnest(range(0, 1::BIGINT << len(extras))) AS pick FROM sl)
    UNION SELECT b.unit, n, list_sort(list_distinct(base || list_filter(range(1, n + 1), lambda k: NOT list_contains(support, k)))) FROM bases b JOIN (SELECT unit, list(DISTINCT x) AS support FROM (SELECT unit, unnest(p1) AS x FROM p UNION ALL SELECT unit, unnest(p2) FROM q) GROUP BY 1) x ON x.unit = b.unit),
  pc AS (SELECT made.*, list_sum(list_transform(list_filter(ids, lambda k: k <= 64), lambda k: CASE WHEN k = 64 THEN -9223372036854775808 ELSE 1::BIGINT << (k - 1) END))::BIGINT AS mask, array_to_string(list_filter(ids, lambda k: k > 64), ',') AS more,
    list_transform(range(1, len(ids) + 1), lambda k: list_sum(list_transform(ids[1:k], lambda j: costs[j])) + CASE WHEN k = 1 THEN {d.SINGLE} ELSE 0 END) AS prefix FROM made JOIN u ON u.unit = made.unit),
  dom AS (SELECT *, coalesce(prefix[len(prefix)], 0)::BIGINT AS cost FROM pc),
  ev AS (SELECT *, CASE ((mask % 5 * 7 + unit) % 5 + 5) % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'UNKNOWN' WHEN 3 THEN 'FAIL' END AS status
    FROM (SELECT *, unnest({list(BUDGETS)})::BIGINT AS budget FROM dom) WHERE len(list_filter(prefix, lambda c: c > budget)) = 0)"""

_SOLUTIONS = f"""sol AS (SELECT unit, mask, {list(ARCHITECTURES)}[g + 1] AS architecture, cost + g * len(ids) * 9 AS cost, CASE (mask % 5 * 7 + unit + g * 3) % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'UNKNOWN' ELSE 'PASS' END AS status
  FROM (SELECT *, unnest(range(0, {len(ARCHITECTURES)})) AS g FROM dom))"""
_WHOLE_SOLUTIONS = _SOLUTIONS.replace("SELECT unit, mask, ", "SELECT unit, mask, more, ").replace("(mask % 5 * 7 + unit + g * 3) % 4", "((mask % 5 * 7 + unit + g * 3) % 4 + 4) % 4")

QUERIES = {
    "package_product": (package_product, f"WITH {_DOMAIN} SELECT unit, base FROM bases"),
    "context_order": (context_order, f"WITH {_DOMAIN} SELECT unit, base, id, place FROM o"),
    "candidate_domain": (candidate_domain, f"WITH {_DOMAIN} SELECT unit, mask, ['full', 'shortlist', 'outside'][priority] AS kind, base, cost FROM dom"),
    "unit_status": (
        unit_status,
        f"""WITH {_DOMAIN} SELECT unit, count(*) AS n, (sum(cost) + CASE WHEN count(*) = 1 THEN {d.SINGLE} ELSE 0 END)::BIGINT AS full_cost,
  CASE WHEN count(*) > {d.MOST} THEN 'too_many_sources' WHEN sum(cost) + CASE WHEN count(*) = 1 THEN {d.SINGLE} ELSE 0 END > {LIMIT} THEN 'over_input_limit' ELSE 'ok' END AS status FROM s GROUP BY unit""",
    ),
    "prefix_reachable": (prefix_reachable, f"WITH {_WHOLE} SELECT unit, mask, more, budget FROM ev"),
    "cost_bounds": (
        cost_bounds,
        f"""WITH {_WHOLE}, b AS (SELECT unit, budget, min(cost) FILTER (WHERE status IS DISTINCT FROM 'FAIL') AS lower, min(cost) FILTER (WHERE status = 'PASS') AS upper, count(*) FILTER (WHERE status IS NULL) AS unseen, count(*) FILTER (WHERE status = 'UNKNOWN') AS unknown FROM ev GROUP BY ALL)
SELECT *, upper - lower AS gap, coalesce(upper = lower, false) AS closed FROM b""",
    ),
    "budget_archive": (budget_archive, f"WITH {_WHOLE}, b AS (SELECT unit, budget, count(*) AS reachable, count(*) FILTER (WHERE status = 'PASS') AS successful, min(row(cost, ids, mask, more)) FILTER (WHERE status = 'PASS') AS w FROM ev GROUP BY ALL) SELECT unit, budget, reachable, successful, w[3] AS best_mask, w[4] AS best_more FROM b"),
    "form_coverage": (
        form_coverage,
        f"WITH {_WHOLE} SELECT unit, mask, more, EXISTS (SELECT 1 FROM p WHERE p.unit = dom.unit AND list_has_all(ids, p1)) AND EXISTS (SELECT 1 FROM q WHERE q.unit = dom.unit AND list_has_all(ids, p2)) AS covers FROM dom",
    ),
    "archive_jaccard": (
        archive_jaccard,
        f"""WITH {_WHOLE}, f AS (SELECT unit, mask, more, max((budget = 128)::INT) AS a, max((budget = 256)::INT) AS b, max((budget = 512)::INT) AS c FROM ev WHERE status = 'PASS' GROUP BY ALL)
SELECT unit, round(sum(a * b)::DOUBLE / nullif(sum(greatest(a, b)), 0), 9) AS j_128_256, round(sum(b * c)::DOUBLE / nullif(sum(greatest(b, c)), 0), 9) AS j_256_512 FROM f GROUP BY 1""",
    ),
    "evaluation_order": (evaluation_order, f"WITH {_WHOLE} SELECT unit, mask, more, place FROM (SELECT unit, mask, more, row_number() OVER (PARTITION BY unit ORDER BY len(ids) <> n, cost, ids) AS place FROM dom) WHERE place <= 16"),
    "conservative_cost": (conservative_cost, f"WITH {_WHOLE}, {_WHOLE_SOLUTIONS} SELECT unit, mask, more, max(cost) AS conservative_cost, string_agg(architecture, ',' ORDER BY architecture) FILTER (WHERE cost <= 256) AS feasible FROM sol GROUP BY ALL".replace("string_agg(", "coalesce(string_agg(").replace("WHERE cost <= 256) AS", "WHERE cost <= 256), '') AS")),
    "architecture_gain": (
        architecture_gain,
        f"""WITH {_WHOLE}, {_WHOLE_SOLUTIONS}, v AS (SELECT *, CASE status WHEN 'PASS' THEN 1e0 WHEN 'FAIL' THEN -1e0 ELSE 0e0 END AS utility FROM sol),
  x AS (SELECT unit, mask, more, max(utility) - max(utility) FILTER (WHERE architecture = 'Flat') AS gain FROM v GROUP BY ALL)
SELECT unit, count(*) FILTER (WHERE gain > 0) AS better, round(avg(gain), 9) AS mean_gain, max(gain) AS best_gain FROM x GROUP BY 1""",
    ),
    "solution_labels": (
        solution_labels,
        f"WITH {_DOMAIN}, {_SOLUTIONS} SELECT unit, architecture, mask, cost, CASE WHEN cost <= 256 THEN 1 ELSE 2 END::BIGINT AS archive FROM sol WHERE status = 'PASS'",
    ),
    "train_rows": (
        train_rows,
        f"""WITH {_WHOLE}, l AS (SELECT *, (mask % 3 + unit) % 3 = 0 AND (status = 'PASS' OR (status = 'UNKNOWN' AND unit % 4 = 0)) AS label FROM ev)
SELECT unit, budget, count(*) FILTER (WHERE label) AS labels, count(*) FILTER (WHERE label AND status <> 'PASS') AS unverified, count(*) FILTER (WHERE label) > 0 AND count(*) FILTER (WHERE label AND status <> 'PASS') = 0 AS usable FROM l GROUP BY ALL""",
    ),
    "train_selection": (
        train_selection,
        f"WITH {_DOMAIN}, l AS (SELECT unit, budget, count(*) FILTER (WHERE (mask + unit) % 3 = 0 AND status = 'PASS') AS labels FROM ev GROUP BY ALL) SELECT * FROM l WHERE labels > 0 ORDER BY budget, unit LIMIT 40",
    ),
    "tri_state_audit": (
        tri_state_audit,
        """WITH a AS (SELECT d.doc_id, CASE quality WHEN 0 THEN 'FAIL' WHEN 1 THEN 'PASS' ELSE 'UNKNOWN' END AS source_audit, CASE toxic WHEN 1 THEN 'FAIL' WHEN 0 THEN 'PASS' ELSE 'UNKNOWN' END AS requirement_audit,
  CASE WHEN n_chars > 0 THEN 'PASS' WHEN n_chars <= 0 THEN 'FAIL' ELSE 'UNKNOWN' END AS structure_audit FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT *, CASE WHEN 'FAIL' IN (source_audit, requirement_audit, structure_audit) THEN 'FAIL' WHEN 'UNKNOWN' IN (source_audit, requirement_audit, structure_audit) THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM a""",
    ),
    "utility_coverage": (
        utility_coverage,
        f"""WITH {_DOMAIN}, r AS (SELECT unit, (unit * 13 + id * 29) % 100 / 1e2 AS q, CASE WHEN unit % 7 = 0 AND id = 2 THEN NULL ELSE cost END AS usage FROM s),
  m AS (SELECT unit, round(avg(q), 9) AS utility, round(avg((q >= 4e-1)::INT::DOUBLE), 9) AS coverage, round((CASE WHEN count(usage) = count(*) THEN sum(usage) END)::DOUBLE / count(*), 9) AS lifecycle_cost FROM r GROUP BY 1)
SELECT *, CASE WHEN utility >= 4e-1 AND coverage >= 5e-1 THEN 'PASS' ELSE 'FAIL' END AS status FROM m""",
    ),
}
