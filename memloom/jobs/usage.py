"""Scores, usage, journals and state over events and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators import bootstrap, state
from memloom.operators.certify import guarded_sum
from memloom.sources.tables import table
from memloom.streaming import state as streaming


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as score rows: type is the arm, user the sample; every 997th has no token count."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("arm"), F.col("user_id").alias("sample_id"), "event_id", F.expr("event_id % 5 + 1").alias("category"),
        F.least(F.lit(1.0), F.col("value") / F.lit(100.0)).alias("score"), (F.col("value") > 50).cast("double").alias("exact_match"),
        (F.col("value") > 5).alias("ok"), F.expr("if(event_id % 997 = 3, NULL, cast(floor(value) AS bigint))").alias("tokens"),
    )


def arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and cost of each arm; the macro score averages samples, and totals need every row's count."""
    rows = _scores(spark, sf_dir)
    answerable = F.col("category") <= 4
    mean = lambda value, use: F.round(F.avg(F.when(use, value)), 9)
    flat = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(answerable).alias("items_1_4"), F.count_if(~answerable).alias("items_5"),
        mean(F.col("score"), answerable).alias("qa_weighted_1_4"), mean(F.col("score"), ~answerable).alias("category_5_refusal"), mean(F.col("exact_match"), answerable).alias("exact_match"),
        F.round(F.avg(F.col("ok").cast("double")), 9).alias("ok_rate"), F.round(F.avg("tokens"), 9).alias("tokens_avg"), F.count("tokens").alias("tokens_known"), guarded_sum(F.col("tokens")).alias("tokens_total"),
    )
    macro = rows.where(answerable).groupBy("arm", "sample_id").agg(F.avg("score").alias("m")).groupBy("arm").agg(F.round(F.avg("m"), 9).alias("group_macro"))
    return flat.join(macro, "arm")


def arm_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each arm by category."""
    return _scores(spark, sf_dir).groupBy("arm", "category").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg("score"), 9).alias("score"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by arm and category with subtotals and a grand total (null keys)."""
    rows = _scores(spark, sf_dir).withColumn("category", F.col("category").cast("string"))
    return rows.rollup("arm", "category").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("reported"), F.count_if(~F.col("ok")).alias("failures"))


def guarded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of each sample: null unless every call is complete, next to what was reported."""
    return _scores(spark, sf_dir).groupBy("sample_id").agg(guarded_sum(F.col("tokens")).alias("total"), F.sum("tokens").alias("reported"), F.count(F.lit(1)).alias("calls"))


def _arm_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).groupBy("arm", "sample_id").agg(F.avg("score").alias("score"), F.sum("tokens").alias("tokens"))


def paired_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm against 'view' over the samples of both: mean gap, samples worse, and tokens saved."""
    means = _arm_means(spark, sf_dir)
    base = means.where("arm = 'view'").select("sample_id", F.col("score").alias("base_score"), F.col("tokens").alias("base_tokens"))
    both = means.where("arm <> 'view'").join(base, "sample_id")
    return both.groupBy("arm").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(F.col("base_score") - F.col("score")), 9).alias("gap"), F.count_if(F.col("score") < F.col("base_score")).alias("worse"), F.round(1.0 - F.sum("tokens") / F.sum("base_tokens"), 9).alias("saving"))


def paired_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys (sample, category) that only one of two arms has, by full outer join."""
    keys = _scores(spark, sf_dir).groupBy("arm", "sample_id", "category").agg(F.count(F.lit(1)).alias("n"))
    a = keys.where("arm = 'view'").select("sample_id", "category", F.lit(1).alias("a"))
    b = keys.where("arm = 'click'").select("sample_id", "category", F.lit(1).alias("b"))
    return a.join(b, ["sample_id", "category"], "full_outer").where("a IS NULL OR b IS NULL").select("sample_id", "category", F.col("a").isNotNull().alias("in_view"))


def budget_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per seed group the smallest budget that all its seeds pass, by upper bound and saving."""
    runs = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("model"), F.expr("element_at(array(1024, 2048, 4096), int(l_linenumber % 3) + 1)").cast("long").alias("budget"), (F.col("l_suppkey") % 3).alias("seed"), F.col("l_discount").cast("double").alias("loss"), F.col("l_tax").cast("double").alias("saving"))
    seeds = runs.groupBy("model", "budget", "seed").agg(F.avg("loss").alias("loss"), F.avg("saving").alias("saving"))
    passed = seeds.groupBy("model", "budget").agg(F.bool_and((F.round("loss", 9) <= 0.052) & (F.col("saving") > 0)).alias("passed"))
    return passed.groupBy("model").agg(F.min(F.when(F.col("passed"), F.col("budget"))).alias("budget"))


def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and population deviation (at least 1e-6) of values by event type, with the number of users."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("value"), F.lit(1e-6)), 6).alias("scale"), F.count_distinct("user_id").alias("users"))


def zscore_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised values, with the type one-hot as a position in the sorted types."""
    events = table(spark, sf_dir, "events")
    stats = events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(1e-6)).alias("scale"))
    return events.join(stats, "event_type").select("event_id", "event_type", F.round((F.col("value") - F.col("mean")) / F.col("scale"), 5).alias("z"))


def session_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written in three ways and one broken way, parsed back to seconds and ages in days."""
    events = table(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    text = F.expr("CASE event_id % 4 WHEN 0 THEN date_format(minute, \"h:mm a 'on' d MMMM, yyyy\") WHEN 1 THEN date_format(minute, 'yyyy/MM/dd (EEE) HH:mm') WHEN 2 THEN date_format(minute, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE 'someday' END")
    written = events.select("event_id", text.alias("text"))
    parsed = F.coalesce(F.try_to_timestamp("text", F.lit("h:mm a 'on' d MMMM, yyyy")), F.try_to_timestamp(F.regexp_replace("text", " \\([A-Za-z]{3}\\)", ""), F.lit("yyyy/MM/dd HH:mm")), F.try_to_timestamp("text", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    seconds = F.unix_timestamp(parsed)
    return written.select("event_id", seconds.alias("seconds"), F.round((F.lit(1706745600) - seconds) / F.lit(86400.0), 6).alias("age_days"))


def bootstrap_ci(spark: SparkSession, sf_dir: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """95 % interval of the mean score gap to 'view' over samples, by resampling as many of them with replacement."""
    means = _arm_means(spark, sf_dir)
    base = means.where("arm = 'view'").select("sample_id", F.col("score").alias("base"))
    gaps = means.where("arm <> 'view'").join(base, "sample_id").select("arm", F.col("sample_id").alias("id"), F.round(F.col("base") - F.col("score"), 12).alias("gap"))
    sorted_means = F.array_sort(F.collect_list("mean"))
    at = lambda share: F.round(F.element_at("means", int(share * (draws - 1)) + 1), 9)
    return bootstrap.picked_means(gaps, "arm", draws, seed).groupBy("arm").agg(sorted_means.alias("means")).select("arm", at(0.025).alias("low"), at(0.975).alias("high"))


def paired_bound(spark: SparkSession, sf_dir: str, draws: int = 10_000, seed: int = 7) -> DataFrame:
    """Over the questions (sample, category) of both arms, categories 1 to 4: loss against 'view', its one-sided 95 % upper bound, and tokens saved."""
    rows = _scores(spark, sf_dir).where("category <= 4").groupBy("arm", "sample_id", "category").agg(F.avg("score").alias("score"), F.sum("tokens").alias("tokens"))
    base = rows.where("arm = 'view'").select("sample_id", "category", F.col("score").alias("base_score"), F.col("tokens").alias("base_tokens"))
    both = rows.where("arm <> 'view'").join(base, ["sample_id", "category"])
    gaps = both.select("arm", (F.col("sample_id") * 10 + F.col("category")).alias("id"), F.round(F.col("base_score") - F.col("score"), 12).alias("gap"))
    upper = bootstrap.resampled_means(gaps, "arm", draws, seed).groupBy("arm").agg(F.round(F.percentile("mean", F.lit(0.95)), 9).alias("one_sided_95_upper"))
    flat = both.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("base_score") - F.col("score")), 9).alias("quality_loss"), F.round(1.0 - F.sum("tokens") / F.sum("base_tokens"), 9).alias("saving_build"))
    return flat.join(upper, "arm")


def paired_summary(spark: SparkSession, sf_dir: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """Each arm against 'view' over the samples of both, categories 1 to 4: mean gap with its 95 % interval, samples worse, and tokens saved."""
    means = _scores(spark, sf_dir).where("category <= 4").groupBy("arm", "sample_id").agg(F.avg("score").alias("score"), F.sum("tokens").alias("tokens"))
    base = means.where("arm = 'view'").select("sample_id", F.col("score").alias("base_score"), F.col("tokens").alias("base_tokens"))
    both = means.where("arm <> 'view'").join(base, "sample_id").withColumn("gap", F.round(F.col("base_score") - F.col("score"), 12))
    ranked = bootstrap.resampled_means(both.select("arm", F.col("sample_id").alias("id"), "gap"), "arm", draws, seed).groupBy("arm").agg(F.array_sort(F.collect_list("mean")).alias("means"))
    at = lambda share: F.round(F.element_at("means", int(share * (draws - 1)) + 1), 9)
    flat = both.groupBy("arm").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("gap"), 9).alias("gap"), F.count_if(F.col("gap") > 0).alias("worse"), F.round(1.0 - F.sum("tokens") / F.sum("base_tokens"), 9).alias("saving"))
    return flat.join(ranked.select("arm", at(0.025).alias("low"), at(0.975).alias("high")), "arm")


def journal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and type the first event over 30, else the last one."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return state.merge_journal(rows, ["user_id", "event_type"], "event_id", F.col("value") > 30)


def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of which no line is finished yet."""
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


def strict_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of lines that are not unique, and those without an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    keys = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k"))
    repeated = keys.agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("repeated").alias("problem"), "n")
    orphans = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphans").alias("problem"), "n")
    return repeated.unionByName(orphans)


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("place"), "l_partkey", "l_quantity")
    return state.keep_first(lines, ["l_orderkey"], "place").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("double").alias("l_quantity"))


def state_upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every user after all events."""
    return state.upsert(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


def state_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from a stream of events."""
    return streaming.upsert_stream(spark, sf_dir)


def events_watermark_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily usage by type from a stream, for days that the watermark has closed."""
    return streaming.usage_windows(spark, sf_dir)


def label_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the categories of each arm."""
    counts = _scores(spark, sf_dir).groupBy("arm", "category").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("arm")))
    return share.groupBy("arm").agg(F.round(-F.sum(F.col("p") * F.log(F.greatest("p", F.lit(1e-12)))), 9).alias("entropy"))


def group_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that more than one of the splits train, dev and final claims: none may."""
    claims = table(spark, sf_dir, "orders").select("o_custkey", F.expr("CASE WHEN o_orderkey % 50 = 7 THEN 'final' WHEN o_custkey % 10 < 7 THEN 'train' ELSE 'dev' END").alias("split"))
    return state.claimed_twice(claims, "o_custkey", "split").withColumn("groups", F.array_join("groups", ","))


def latest_quota_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the failed calls of each user with a reset still to come, the one that began last."""
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").alias("started"), F.expr("if(event_id % 19 = 4, 402, 200)").alias("http_status"), F.expr("unix_timestamp(ts) + event_id % 7 * 86400").alias("reset"))
    return state.latest_block(calls, ["user_id"], F.lit(1706000000))


def calls_to_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by the digest of what they ask: those replayed from a finished call, to be made, or blocked by one whose end is unknown."""
    asked = table(spark, sf_dir, "events").select("event_id", F.struct("event_type", F.floor(F.col("value") / 4).alias("prompt")).alias("request"))
    keyed = asked.select("event_id", state.digest("request").alias("identity"))
    saved = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(state.digest(F.struct("event_type", F.floor(F.col("value") / 4).alias("prompt"))).alias("identity"), "event_id", F.expr("CASE event_id % 5 WHEN 0 THEN 'in_flight' WHEN 1 THEN 'failed' ELSE 'success' END").alias("status"))
    return state.replay(keyed, saved, "event_id").groupBy("action").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("identity").alias("identities"))


def redacted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of events with secrets masked, and its digest."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"api_key": "sk-'), "event_id", F.lit('", "Authorization": "Bearer '), "user_id", F.lit('", "user": '), "user_id", F.lit("}")).alias("text"))
    return rows.select("event_id", state.redacted(F.col("text")).alias("text")).withColumn("sha256", F.sha2("text", 256))


def break_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads after which each arm's build cost against 'view' is won back; null if reads save nothing."""
    costs = _scores(spark, sf_dir).groupBy("arm", F.lit("view").alias("against")).agg(F.sum(F.when(F.col("category") == 1, F.col("tokens"))).alias("build"), F.avg(F.when(F.col("category") > 1, F.col("tokens"))).alias("read"))
    base = costs.where("arm = 'view'").select("against", F.col("build").alias("base_build"), F.col("read").alias("base_read"))
    saving = F.round(F.col("base_read") - F.col("read"), 9)
    out = costs.where("arm <> 'view'").join(base, "against")
    return out.select("arm", F.when(saving > 0, F.round(F.greatest(F.lit(0.0), (F.col("build") - F.col("base_build")).cast("double")) / saving, 4)).alias("reads"))


_SCORES = """s AS (SELECT event_type AS arm, user_id AS sample_id, event_id, event_id % 5 + 1 AS category, least(1e0, value / 1e2) AS score, (value > 50)::DOUBLE AS exact_match, value > 5 AS ok,
  CASE WHEN event_id % 997 = 3 THEN NULL ELSE floor(value)::BIGINT END AS tokens FROM events)"""
_MEANS = f"{_SCORES}, m AS (SELECT arm, sample_id, avg(score) AS score, sum(tokens)::BIGINT AS tokens FROM s GROUP BY ALL)"


def _resampled(draws: int, seed: int) -> str:
    """CTEs from ``g`` (arm, id, gap) to ``resampled`` (arm, draw, mean)."""
    often = bootstrap.counts_sql("x")
    return f"""picked AS (SELECT arm, gap, draw, {bootstrap.pick_sql('id', 'draw', seed)} AS x FROM (SELECT *, unnest(range(1, {draws + 1})) AS draw FROM g)),
  resampled AS (SELECT arm, draw, sum(gap * {often}) / nullif(sum({often}), 0) AS mean FROM picked GROUP BY arm, draw)"""


def _picked(draws: int, seed: int) -> str:
    """CTEs from ``g`` (arm, id, gap) to ``resampled`` (arm, draw, mean): each draw picks as many rows as the arm has."""
    return f"""numbered AS (SELECT arm, gap, row_number() OVER (PARTITION BY arm ORDER BY id) AS k, count(*) OVER (PARTITION BY arm) AS n FROM g WHERE gap IS NOT NULL),
  drawn AS (SELECT arm, n, draw, {bootstrap.pick_sql('k', 'draw', seed)} % n + 1 AS k FROM (SELECT *, unnest(range(1, {draws + 1})) AS draw FROM numbered)),
  resampled AS (SELECT d.arm, draw, sum(gap) / any_value(d.n) AS mean FROM drawn d JOIN numbered x ON x.arm = d.arm AND x.k = d.k GROUP BY d.arm, draw)"""


_STATE = "SELECT user_id, min(event_id) AS place, max_by(value, event_id) AS value, count(*) AS version FROM events GROUP BY 1"

QUERIES = {
    "arm_scores": (
        arm_scores,
        f"""WITH {_SCORES}, g AS (SELECT arm, round(avg(m), 9) AS group_macro FROM (SELECT arm, sample_id, avg(score) AS m FROM s WHERE category <= 4 GROUP BY ALL) GROUP BY 1)
SELECT s.arm, count(*) AS items, count(*) FILTER (WHERE category <= 4) AS items_1_4, count(*) FILTER (WHERE category > 4) AS items_5, round(avg(score) FILTER (WHERE category <= 4), 9) AS qa_weighted_1_4,
  round(avg(score) FILTER (WHERE category > 4), 9) AS category_5_refusal, round(avg(exact_match) FILTER (WHERE category <= 4), 9) AS exact_match, round(avg(ok::INT::DOUBLE), 9) AS ok_rate, round(avg(tokens), 9) AS tokens_avg,
  count(tokens) AS tokens_known, (CASE WHEN count(tokens) = count(*) THEN sum(tokens) END)::BIGINT AS tokens_total, any_value(group_macro) AS group_macro FROM s JOIN g ON s.arm = g.arm GROUP BY 1""",
    ),
    "arm_by_category": (arm_by_category, f"WITH {_SCORES} SELECT arm, category, count(*) AS items, round(avg(score), 9) AS score FROM s GROUP BY ALL"),
    "usage_rollup": (usage_rollup, f"WITH {_SCORES} SELECT arm, category::VARCHAR AS category, count(*) AS calls, sum(tokens)::BIGINT AS reported, count(*) FILTER (WHERE NOT ok) AS failures FROM s GROUP BY ROLLUP (arm, category)"),
    "guarded_totals": (guarded_totals, f"WITH {_SCORES} SELECT sample_id, (CASE WHEN count(tokens) = count(*) THEN sum(tokens) END)::BIGINT AS total, sum(tokens)::BIGINT AS reported, count(*) AS calls FROM s GROUP BY 1"),
    "paired_gap": (
        paired_gap,
        f"WITH {_MEANS} SELECT a.arm, count(*) AS samples, round(avg(b.score - a.score), 9) AS gap, count(*) FILTER (WHERE a.score < b.score) AS worse, round(1e0 - sum(a.tokens)::DOUBLE / sum(b.tokens), 9) AS saving FROM m a JOIN m b ON a.sample_id = b.sample_id AND b.arm = 'view' WHERE a.arm <> 'view' GROUP BY 1",
    ),
    "paired_key_check": (
        paired_key_check,
        f"WITH {_SCORES}, k AS (SELECT DISTINCT arm, sample_id, category FROM s), a AS (SELECT * FROM k WHERE arm = 'view'), b AS (SELECT * FROM k WHERE arm = 'click') SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.category, b.category) AS category, a.arm IS NOT NULL AS in_view FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.category = b.category WHERE a.arm IS NULL OR b.arm IS NULL",
    ),
    "budget_choice": (
        budget_choice,
        """WITH r AS (SELECT l_orderkey % 97 AS model, [1024, 2048, 4096][(l_linenumber % 3 + 1)::INT]::BIGINT AS budget, l_suppkey % 3 AS seed, avg(l_discount::DOUBLE) AS loss, avg(l_tax::DOUBLE) AS saving FROM lineitem GROUP BY ALL),
  p AS (SELECT model, budget, bool_and(round(loss, 9) <= 52e-3 AND saving > 0) AS passed FROM r GROUP BY ALL)
SELECT model, min(budget) FILTER (WHERE passed) AS budget FROM p GROUP BY 1""",
    ),
    "feature_stats": (feature_stats, "SELECT event_type, round(avg(value), 6) AS mean, round(greatest(stddev_pop(value), 1e-6), 6) AS scale, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "zscore_features": (zscore_features, "SELECT event_id, event_type, round((value - avg(value) OVER w) / greatest(stddev_pop(value) OVER w, 1e-6), 5) AS z FROM events WINDOW w AS (PARTITION BY event_type)"),
    "session_dates": (
        session_dates,
        "WITH p AS (SELECT event_id, CASE WHEN event_id % 4 < 3 THEN epoch(date_trunc('minute', ts))::BIGINT END AS seconds FROM events) SELECT event_id, seconds, round((1706745600 - seconds) / 864e2, 6) AS age_days FROM p",
    ),
    "bootstrap_ci": (
        bootstrap_ci,
        f"""WITH {_MEANS}, g AS (SELECT a.arm, a.sample_id AS id, round(b.score - a.score, 12) AS gap FROM m a JOIN m b ON a.sample_id = b.sample_id AND b.arm = 'view' WHERE a.arm <> 'view'), {_picked(2000, 7)}
SELECT arm, round(list_sort(list(mean))[50], 9) AS low, round(list_sort(list(mean))[1950], 9) AS high FROM resampled GROUP BY 1""",
    ),
    "paired_summary": (
        paired_summary,
        f"""WITH {_SCORES}, m AS (SELECT arm, sample_id, avg(score) AS score, sum(tokens)::BIGINT AS tokens FROM s WHERE category <= 4 GROUP BY ALL),
  p AS (SELECT a.arm, a.sample_id AS id, round(b.score - a.score, 12) AS gap, a.tokens, b.tokens AS base_tokens FROM m a JOIN m b ON a.sample_id = b.sample_id AND b.arm = 'view' WHERE a.arm <> 'view'),
  g AS (SELECT arm, id, gap FROM p), {_resampled(2000, 7)}, i AS (SELECT arm, round(list_sort(list(mean))[50], 9) AS low, round(list_sort(list(mean))[1950], 9) AS high FROM resampled GROUP BY 1)
SELECT p.arm, count(*) AS samples, round(avg(gap), 9) AS gap, count(*) FILTER (gap > 0) AS worse, round(1e0 - sum(tokens)::DOUBLE / sum(base_tokens), 9) AS saving, any_value(low) AS low, any_value(high) AS high FROM p JOIN i ON i.arm = p.arm GROUP BY 1""",
    ),
    "paired_bound": (
        paired_bound,
        f"""WITH {_SCORES}, m AS (SELECT arm, sample_id, category, avg(score) AS score, sum(tokens)::BIGINT AS tokens FROM s WHERE category <= 4 GROUP BY ALL),
  p AS (SELECT a.arm, a.sample_id * 10 + a.category AS id, b.score - a.score AS raw, a.tokens, b.tokens AS base_tokens FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.category = b.category AND b.arm = 'view' WHERE a.arm <> 'view'),
  g AS (SELECT arm, id, round(raw, 12) AS gap FROM p), {_resampled(10_000, 7)}, up AS (SELECT arm, round(quantile_cont(mean, 0.95), 9) AS one_sided_95_upper FROM resampled GROUP BY 1)
SELECT p.arm, count(*) AS n, round(avg(raw), 9) AS quality_loss, round(1e0 - sum(tokens)::DOUBLE / sum(base_tokens), 9) AS saving_build, any_value(one_sided_95_upper) AS one_sided_95_upper FROM p JOIN up ON up.arm = p.arm GROUP BY 1""",
    ),
    "journal_merge": (
        journal_merge,
        """WITH g AS (SELECT user_id, event_type, coalesce(min(event_id) FILTER (WHERE value > 30), max(event_id)) AS event_id, count(*) FILTER (WHERE value > 30) > 0 AS done FROM events GROUP BY ALL)
SELECT g.user_id, g.event_type, done, g.event_id, value FROM g JOIN events USING (event_id)""",
    ),
    "resume_anti_join": (resume_anti_join, "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')"),
    "strict_key_check": (
        strict_key_check,
        """SELECT 'repeated' AS problem, count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orphans', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    ),
    "dedup_keep_first": (dedup_keep_first, "SELECT l_orderkey, l_partkey, l_quantity::DOUBLE AS l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r FROM lineitem) WHERE r = 1"),
    "state_upsert_batch": (state_upsert_batch, _STATE),
    "state_upsert_stream": (state_upsert_stream, _STATE),
    "events_watermark_window": (
        events_watermark_window,
        """SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events
GROUP BY ALL HAVING max(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    ),
    "label_entropy": (label_entropy, f"WITH {_SCORES}, c AS (SELECT arm, category, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT arm, n / sum(n) OVER (PARTITION BY arm)::DOUBLE AS p FROM c) SELECT arm, round(-sum(p * ln(greatest(p, 1e-12))), 9) AS entropy FROM p GROUP BY 1"),
    "group_overlap": (
        group_overlap,
        "SELECT o_custkey, string_agg(DISTINCT split, ',' ORDER BY split) AS groups FROM (SELECT o_custkey, CASE WHEN o_orderkey % 50 = 7 THEN 'final' WHEN o_custkey % 10 < 7 THEN 'train' ELSE 'dev' END AS split FROM orders) GROUP BY 1 HAVING count(DISTINCT split) > 1",
    ),
    "latest_quota_block": (
        latest_quota_block,
        "SELECT user_id, event_id, started, reset FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started DESC, event_id DESC) AS r FROM (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS started, epoch(date_trunc('second', ts))::BIGINT + event_id % 7 * 86400 AS reset FROM events WHERE event_id % 19 = 4) WHERE reset > 1706000000) WHERE r = 1",
    ),
    "calls_to_make": (
        calls_to_make,
        """WITH k AS (SELECT event_id, event_type || '/' || floor(value / 4)::BIGINT AS identity FROM events),
  s AS (SELECT identity, bool_or(event_id % 5 > 1) AS done, bool_or(event_id % 5 = 0) AS flight FROM k WHERE event_id % 3 = 0 GROUP BY 1)
SELECT CASE WHEN done THEN 'replay' WHEN flight THEN 'blocked' ELSE 'call' END AS action, count(*) AS requests, count(DISTINCT k.identity) AS identities FROM k LEFT JOIN s ON s.identity = k.identity GROUP BY 1""",
    ),
    "redacted_rows": (
        redacted_rows,
        """WITH t AS (SELECT event_id, '{"api_key": "***", "Authorization": "***", "user": ' || user_id || '}' AS text FROM events) SELECT *, sha256(text) AS sha256 FROM t""",
    ),
    "break_even": (
        break_even,
        f"""WITH {_SCORES}, c AS (SELECT arm, sum(tokens) FILTER (WHERE category = 1) AS build, avg(tokens) FILTER (WHERE category > 1) AS read FROM s GROUP BY 1),
  x AS (SELECT a.arm, a.build - b.build AS offline, round(b.read - a.read, 9) AS saving FROM c a JOIN c b ON b.arm = 'view' AND a.arm <> 'view')
SELECT arm, CASE WHEN saving > 0 THEN round(greatest(0e0, offline::DOUBLE) / saving, 4) END AS reads FROM x""",
    ),
}
