"""Feature rows, attached vectors and builder inputs over embeddings, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.operators import builder, cache
from memloom.operators import features as f
from memloom.sources.tables import table

#: Components of the given vectors.
DIMENSION = 64
NUMBERS = len(f.NUMERIC)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as sources of their label's unit, with stand-in fields: some are text, missing, or no numbers."""
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").where(f.vector_problem("embedding", DIMENSION).isNull())
    fields = rows.selectExpr(
        "vec_id", "label AS unit", "embedding", "if(vec_id % 20 = 0, embedding, NULL) AS query_vector", "if(vec_id % 11 = 0, NULL, concat('speaker ', vec_id % 5)) AS speaker",
        "if(vec_id % 13 = 1, 'n/a', string(vec_id % 40)) AS position", "vec_id % 50 + 3 AS token_count", "if(vec_id % 7 = 0, NULL, vec_id % 30 / 4D) AS relative_time_days",
        "timestamp_seconds(1706745600) AS now", "timestamp_seconds(1706745600 - vec_id * 3600) AS session_datetime",
        "CASE vec_id % 9 WHEN 2 THEN 'nan' WHEN 5 THEN NULL ELSE string(vec_id % 8 / 8D) END AS score", "vec_id % 3 = 1 AS dense_rank",
    )
    return fields.withColumn("numbers", f.numbers(fields, "now"))


def source_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeric features of each source; null where a field is missing or no number."""
    names = {name: F.round(F.get("numbers", F.lit(i)), 9).alias(name) for i, name in enumerate(f.NUMERIC)}
    return _rows(spark, sf_dir).select("vec_id", *names.values())


def feature_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and scale of each numeric feature, and the sorted speakers."""
    fitted = f.fit(_rows(spark, sf_dir))
    place = F.posexplode(F.arrays_zip("means", "scales")).alias("place", "m")
    return fitted.select(place, "speakers").select(F.col("place").cast("long").alias("place"), F.round("m.means", 9).alias("mean"), F.round("m.scales", 9).alias("scale"), F.array_join("speakers", ",").alias("speakers"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each feature row: its width, sums over its parts, the speaker's place and the budget."""
    rows = _rows(spark, sf_dir)
    out = f.transform(rows.select("vec_id", "unit", "embedding", "query_vector", "numbers", "speaker"), f.fit(rows), DIMENSION, budget=2048.0)
    part = lambda start, n: F.slice("features", start + 1, n)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    numeric = 4 * DIMENSION
    hot = F.slice("features", F.lit(numeric + 2 * NUMBERS + 1), F.size("features") - numeric - 2 * NUMBERS - 1)
    return out.select(
        "vec_id", F.size("features").cast("long").alias("width"), F.round(total(part(2 * DIMENSION, DIMENSION)), 6).alias("interaction"),
        F.round(total(part(3 * DIMENSION, DIMENSION)), 6).alias("difference"), F.round(total(part(numeric, NUMBERS)), 6).alias("standardised"),
        total(part(numeric + NUMBERS, NUMBERS)).cast("long").alias("missing"), (F.array_position(hot, 1.0) - 1).cast("long").alias("speaker"), F.element_at("features", -1).alias("budget"),
    )


def attached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vectors of the same id, some of them broken, and what is wrong with each."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS doc_id", """CASE vec_id % 17 WHEN 3 THEN slice(embedding, 1, 8) WHEN 5 THEN transform(embedding, x -> 0F)
      WHEN 7 THEN transform(embedding, (x, i) -> if(i = 2, float('NaN'), x)) WHEN 9 THEN transform(embedding, (x, i) -> if(i = 1, NULL, x)) ELSE embedding END AS embedding""")
    rows = table(spark, sf_dir, "documents", "doc_id").join(vectors, "doc_id", "left")
    return rows.select("doc_id", F.coalesce(f.vector_problem("embedding", DIMENSION), F.lit("usable")).alias("vector"))


def builder_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain builder's input of each conversation: its length and SHA-256."""
    source = F.struct((F.col("turn") + 1).alias("id"), F.col("turn").alias("position"), F.expr("if(turn % 5 = 4, NULL, concat('s', turn div 3))").alias("session"), F.concat_ws(":", "conv_id", "turn").alias("source_id"),
                      F.lit(None).cast("long").alias("source_offset"), F.col("role").alias("speaker"), "text", F.lit(None).cast("string").alias("time"))
    units = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(source).alias("sources"))
    empty = F.array().cast("array<int>")
    units = units.withColumn("structure", F.struct(F.lit("Flat").alias("architecture"), empty.alias("edges"), empty.alias("groups"), F.array_sort("sources.id").alias("nodes")))
    text = builder.input_json("sources", "structure", F.lit("Flat"), F.lit("no order"), "memory-1")
    return units.select("conv_id", text.alias("text")).select("conv_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def future_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries of each turn from one of two lists, from its own answer, or none; some lack their question."""
    query = "named_struct('question', {q}, 'answer', role, 'category', int(turn % 5 + 1))"
    lists = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", f"if(turn % 4 = 0, array({query.format(q='text')}, {query.format(q='if(conv_id % 3 = 0, NULL, role)')}), NULL) AS future_queries",
        f"if(turn % 4 = 1, array({query.format(q='role')}), NULL) AS queries", "if(conv_id % 5 = 0, NULL, role) AS question", "if(turn % 4 = 2, role, NULL) AS answer", "if(conv_id % 2 = 0, NULL, 3) AS category",
    )
    rows = lists.withColumn("q", builder.future_queries(lists))
    return rows.select("conv_id", "turn", F.size("q").cast("long").alias("queries"), F.array_join("q.question", "|").alias("questions"), F.array_join(F.transform("q.category", lambda c: c.cast("string")), ",").alias("categories"))


def recall_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached rankings of turns with the evidence recall of evidence that was normalised since."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    rows = turns.select("conv_id", "turn", F.expr("array(turn, turn + 1, turn + 3)").alias("source_ids"), F.lit(0.0).alias("evidence_recall"))
    evidence = turns.where("turn % 6 <> 5").select("conv_id", "turn", F.expr("array(turn + 1, turn + 2, if(turn % 2 = 0, turn + 3, turn - 1))").alias("wanted"))
    return cache.refreshed(rows, evidence, "conv_id", "turn").select("conv_id", "turn", F.round("evidence_recall", 9).alias("evidence_recall"))


_NUMBERS = """r AS (SELECT vec_id, label AS unit, embedding, CASE WHEN vec_id % 11 <> 0 THEN 'speaker ' || vec_id % 5 END AS speaker, CASE WHEN vec_id % 13 <> 1 THEN (vec_id % 40)::DOUBLE END AS position, (vec_id % 50 + 3)::DOUBLE AS token_count,
    CASE WHEN vec_id % 7 = 0 THEN vec_id / 24e0 ELSE vec_id % 30 / 4e0 END AS age_days, CASE WHEN vec_id % 9 NOT IN (2, 5) THEN vec_id % 8 / 8e0 END AS retrieval_score FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  n AS (SELECT *, [position, token_count, age_days, retrieval_score, NULL, NULL, retrieval_score, NULL] AS numbers FROM r)"""
_FITTED = """e AS (SELECT unnest(range(1, 9)) AS i, unnest(numbers) AS x FROM n),
  fit AS (SELECT i, coalesce(avg(x), 0e0) AS mean, CASE WHEN count(x) > 0 THEN greatest(stddev_pop(x), 1e-6) ELSE 1e0 END AS scale FROM e GROUP BY 1),
  speakers AS (SELECT list_sort(list(DISTINCT speaker)) AS names FROM n WHERE speaker IS NOT NULL)"""
_JSON_SYSTEM = builder.SYSTEM

QUERIES = {
    "source_numbers": (source_numbers, f"WITH {_NUMBERS} SELECT vec_id, position, token_count, round(age_days, 9) AS age_days, retrieval_score, NULL::DOUBLE AS bm25_rank, NULL::DOUBLE AS dense_rank, retrieval_score AS rrf_score, NULL::DOUBLE AS cosine_similarity FROM n"),
    "feature_schema": (feature_schema, f"WITH {_NUMBERS}, {_FITTED} SELECT i - 1 AS place, round(mean, 9) AS mean, round(scale, 9) AS scale, array_to_string(names, ',') AS speakers FROM fit, speakers"),
    "feature_rows": (
        feature_rows,
        f"""WITH {_NUMBERS}, {_FITTED}, f AS (SELECT list(mean ORDER BY i) AS means, list(scale ORDER BY i) AS scales FROM fit),
  d AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM n), v AS (SELECT *, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM d),
  x AS (SELECT unit, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v), m AS (SELECT unit, i, avg(x) AS x FROM x GROUP BY ALL), g AS (SELECT unit, list(x ORDER BY i) AS g FROM m GROUP BY 1),
  c AS (SELECT v.*, CASE WHEN vec_id % 20 = 0 THEN v ELSE list_transform(g, lambda x: x / sqrt(list_dot_product(g, g))) END AS c FROM v JOIN g USING (unit))
SELECT vec_id, 4 * 64 + 16 + len(names) + 2 AS width, round(list_dot_product(v, c), 6) AS interaction, round(list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - c[i]))), 6) AS difference,
  round(list_sum(list_transform(range(1, 9), lambda i: coalesce((numbers[i] - means[i]) / scales[i], 0e0))), 6) AS standardised, 8 - len(list_filter(numbers, lambda x: x IS NOT NULL)) AS missing,
  coalesce(list_position(names, speaker), 0)::BIGINT AS speaker, 5e-1 AS budget FROM c, f, speakers""",
    ),
    "attached_vectors": (
        attached_vectors,
        """SELECT doc_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN vec_id % 17 IN (3, 5, 7, 9) OR len(embedding) <> 64 OR len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) < 64 OR len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'invalid' ELSE 'usable' END AS vector
FROM documents LEFT JOIN embeddings ON doc_id = vec_id""",
    ),
    "builder_inputs": (
        builder_inputs,
        f"""WITH s AS (SELECT conv_id, string_agg(format('{{{{"id":{{}},"position":{{}},"session":{{}},"source_id":"{{}}:{{}}","source_offset":null,"speaker":{{}},"text":{{}},"time":null}}}}', turn + 1, turn,
    CASE WHEN turn % 5 = 4 THEN 'null' ELSE '"s' || turn // 3 || '"' END, conv_id, turn, coalesce(to_json(role)::VARCHAR, 'null'), to_json(coalesce(text, ''))::VARCHAR), ',' ORDER BY turn) AS sources, string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) AS nodes FROM conversations GROUP BY 1),
  t AS (SELECT conv_id, '{{"architecture":"Flat","architecture_contract":"no order","output":{{"item":{{"m":"string","src":"integer[]"}},"max_items":{builder.MAX_ITEMS},"type":"array"}},"schema":"memory-1","sources":[' || sources || '],"structure":{{"architecture":"Flat","edges":[],"groups":[],"nodes":[' || nodes || ']}},"system":"{_JSON_SYSTEM}","write_stage":true}}' AS text FROM s)
SELECT conv_id, length(text) AS n_chars, sha256(text) AS sha256 FROM t""",
    ),
    "future_queries": (
        future_queries,
        """WITH q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN conv_id % 3 = 0 THEN [text] ELSE [text, role] END WHEN 1 THEN [role] WHEN 2 THEN [CASE WHEN conv_id % 5 = 0 THEN '' ELSE role END] ELSE [] END AS q,
  CASE WHEN turn % 4 = 2 THEN CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 3 END ELSE turn % 5 + 1 END AS c FROM conversations),
  k AS (SELECT * REPLACE (list_filter(q, lambda x: x IS NOT NULL) AS q) FROM q)
SELECT conv_id, turn, len(q) AS queries, array_to_string(q, '|') AS questions, array_to_string(list_transform(q, lambda x: c), ',') AS categories FROM k""",
    ),
    "recall_refresh": (
        recall_refresh,
        "SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN 1e0 ELSE round((CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END) / 3e0, 9) END AS evidence_recall FROM conversations",
    ),
}
