"""Text queries over the turns of all conversations. A turn answers the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import text as t
from memloom.functions.text import SPACE_SQL
from memloom.sources.tables import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text")


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the text of the next one."""
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return _turns(spark, sf_dir).withColumn("answer", following).where("answer IS NOT NULL")


def approx_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated prompt tokens of every turn."""
    return _turns(spark, sf_dir).select("conv_id", "turn", t.approx_tokens(F.col("text")).alias("tokens"))


def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of about 64 tokens of every turn."""
    chunks = F.posexplode(t.budget_chunks(F.col("text"), 64)).alias("chunk_index", "chunk")
    return _turns(spark, sf_dir).select("conv_id", "turn", chunks).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised text of every turn."""
    return _turns(spark, sf_dir).select("conv_id", "turn", t.normalize_answer(F.col("text")).alias("normalized"))


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical score of every turn against the next one."""
    score = t.lexical_score(F.col("text"), F.col("answer"))
    return _answered(spark, sf_dir).select("conv_id", "turn", F.round(score, 9).alias("score"))


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 of every turn against the next one."""
    return _answered(spark, sf_dir).select("conv_id", "turn", F.round(t.token_f1(F.col("text"), F.col("answer")), 9).alias("f1"))


def exact_match_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a turn's token set is the next one's, and whether it is that of its own text with an article and a mark."""
    own = t.exact_match(F.col("text"), F.concat(F.lit("The "), F.col("text"), F.lit("!")))
    return _answered(spark, sf_dir).select("conv_id", "turn", t.exact_match(F.col("text"), F.col("answer")).alias("next_match"), own.alias("own_match"))


def multi_answer_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-split F1 of every turn against the next one."""
    return _answered(spark, sf_dir).select("conv_id", "turn", F.round(t.multi_answer_f1(F.col("text"), F.col("answer")), 9).alias("f1"))


def category_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every turn against the next one by a category that the conversation and turn give."""
    category = (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("long")
    scored = _answered(spark, sf_dir).withColumn("category", category)
    return scored.select("conv_id", "turn", "category", F.round(t.category_score(F.col("category"), F.col("text"), F.col("answer")), 9).alias("score"))


def category_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match of every turn with itself behind an article (or, for category 3, with a first part), by category."""
    category = (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("long")
    scored = _answered(spark, sf_dir).withColumn("category", category).withColumn("gold", F.expr("if(turn % 2 = 0, concat('The ', text, if(category = 3, ' ; because', '')), answer)"))
    return scored.select("conv_id", "turn", "category", t.category_exact_match(F.col("category"), F.col("text"), F.col("gold")).alias("exact_match"))


_PAIRS = "pairs AS (SELECT * FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE answer IS NOT NULL)"
_WORDS = f"list_filter(string_split_regex(text, '{SPACE_SQL}'), lambda w: w <> '')"


def _normal(x: str) -> str:
    bare = f"regexp_replace(lower(replace({x}, ',', '')), '[[:punct:]]', '', 'g')"
    return f"list_filter(string_split_regex({bare}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the', 'and'))"


def _f1(p: str, g: str) -> str:
    shared = f"list_sum(list_transform(list_intersect({p}, {g}), lambda k: least(len(list_filter({p}, lambda y: y = k)), len(list_filter({g}, lambda y: y = k)))))"
    return f"coalesce(2e0 * coalesce({shared}, 0) / nullif(len({p}) + len({g}), 0), 0e0)"


def _parts(x: str) -> str:
    return f"list_transform(list_filter(list_transform(string_split({x}, ','), lambda y: trim(y)), lambda y: y <> ''), lambda z: {_normal('z')})"


_MULTI = "coalesce(list_sum(list_transform(gp, lambda g: list_max(list_transform(pp, lambda p: " + _f1("p", "g") + ")))) / nullif(len(gp), 0), 0e0)"

QUERIES = {
    "approx_token_count": (approx_token_count, f"SELECT conv_id, turn, greatest(1, ceil(len({_WORDS}) * 1.3e0))::BIGINT AS tokens FROM conversations"),
    "token_chunks": (
        token_chunks,
        f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS words FROM conversations)
SELECT conv_id, turn, i::BIGINT AS chunk_index, array_to_string(words[i * 49 + 1:i * 49 + 49], ' ') AS chunk
FROM (SELECT *, unnest(range(0, greatest(1, ceil(len(words) / 49.0)::BIGINT))) AS i FROM w)""",
    ),
    "normalize_answer": (normalize_answer, f"SELECT conv_id, turn, array_to_string({_normal('text')}, ' ') AS normalized FROM conversations"),
    "lexical_overlap": (
        lexical_overlap,
        f"""WITH {_PAIRS}, sets AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS t FROM pairs)
SELECT conv_id, turn, round(len(list_intersect(q, t)) / sqrt((greatest(1, len(q)) * greatest(1, len(t)))::DOUBLE), 9) AS score FROM sets""",
    ),
    "token_f1": (token_f1, f"WITH {_PAIRS}, tokens AS (SELECT conv_id, turn, {_normal('text')} AS p, {_normal('answer')} AS g FROM pairs) SELECT conv_id, turn, round({_f1('p', 'g')}, 9) AS f1 FROM tokens"),
    "exact_match_set": (
        exact_match_set,
        f"""WITH {_PAIRS}, sets AS (SELECT conv_id, turn, list_sort(list_distinct({_normal("text")})) AS p, list_sort(list_distinct({_normal("answer")})) AS g, list_sort(list_distinct({_normal("concat('The ', text, '!')")})) AS u FROM pairs)
SELECT conv_id, turn, (p = g)::DOUBLE AS next_match, (p = u)::DOUBLE AS own_match FROM sets""",
    ),
    "multi_answer_f1": (multi_answer_f1, f"WITH {_PAIRS}, parts AS (SELECT conv_id, turn, {_parts('text')} AS pp, {_parts('answer')} AS gp FROM pairs) SELECT conv_id, turn, round({_MULTI}, 9) AS f1 FROM parts"),
    "category_score": (
        category_score,
        f"""WITH {_PAIRS}, parts AS (
  SELECT conv_id, turn, (conv_id + turn) % 5 + 1 AS category, lower(text) AS low, {_normal("text")} AS p, {_normal("answer")} AS g, {_normal("trim(split_part(answer, ';', 1))")} AS g3, {_parts("text")} AS pp, {_parts("answer")} AS gp FROM pairs)
SELECT conv_id, turn, category, round(CASE category WHEN 1 THEN {_MULTI} WHEN 3 THEN {_f1("p", "g3")} WHEN 5 THEN (contains(low, 'no information available') OR contains(low, 'not mentioned'))::DOUBLE ELSE {_f1("p", "g")} END, 9) AS score FROM parts""",
    ),
    "category_exact_match": (
        category_exact_match,
        f"""WITH {_PAIRS}, c AS (SELECT *, (conv_id + turn) % 5 + 1 AS category FROM pairs), g AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'The ' || text ELSE answer END AS gold FROM c),
  n AS (SELECT conv_id, turn, category, lower(text) AS low, list_sort(list_distinct({_normal("text")})) AS p, list_sort(list_distinct(CASE WHEN category = 3 THEN {_normal("trim(split_part(gold, ';', 1))")} ELSE {_normal("gold")} END)) AS q FROM g)
SELECT conv_id, turn, category, (CASE WHEN category = 5 THEN contains(low, 'no information available') OR contains(low, 'not mentioned') ELSE p = q END)::INT::DOUBLE AS exact_match FROM n""",
    ),
}
