"""Retrieval queries: benchmark items ask the documents, vectors ask the vectors of their label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import lexical_score
from memloom.operators import dense
from memloom.operators import retrieval as r
from memloom.sources.tables import spread, table


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text"))


def bm25_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every token of the documents."""
    return r.document_frequency(r.postings(_docs(spark, sf_dir), "source_id"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best documents for each benchmark item."""
    return r.bm25_top_k(_items(spark, sf_dir), _docs(spark, sf_dir), 5)


def _dense(spark: SparkSession, sf_dir: str, k: int, only: DataFrame | None = None) -> DataFrame:
    """For every vector whose id is divisible by 20 at least the k nearest others of its label; of the ids in ``only`` (source_id), if given."""
    vectors = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    if only is not None:
        vectors = vectors.join(only.select(F.col("source_id").alias("vec_id")), "vec_id", "left_semi")
    units = spread(vectors).select("label", F.col("vec_id").alias("source_id"), r.unit(F.col("embedding")).alias("unit"))
    asked = units.where("source_id % 20 = 0").withColumnRenamed("source_id", "question_id")
    return dense.block_top_k(asked, units, "label", k)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of the label for each asking vector."""
    return r.top_k(_dense(spark, sf_dir, 5), 5, "question_id")


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with documents ask by text and by vector within their label; both top 20 fused to 10."""
    vectors = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("source_id"), "label")
    docs = _docs(spark, sf_dir).join(vectors, "source_id")
    asked = docs.where("source_id % 20 = 0").select("label", F.col("source_id").alias("question_id"), "text")
    lexical = r.bm25_top_k(asked, docs, 20, "label", itself=False).select("question_id", "source_id", "rank")
    return r.fuse(lexical, r.top_k(_dense(spark, sf_dir, 20, docs.select("source_id").distinct()), 20, "question_id"), 10, "question_id")


#: Words of a run that an item is looked up by, at most.
RUN = 4


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's text.

    Between two spaces an item's words stand in the document as they are, so a run of its inner words
    (up to RUN from its second word) finds the documents, and the text verifies them. Items of one or two words have no
    inner word: they, as a rule few, are looked for in every document.
    """
    items = _items(spark, sf_dir).select("question_id", F.col("text").alias("item"), F.split("text", " ").alias("words"))
    items = items.where("item <> ''").withColumn("run", F.least(F.lit(RUN), F.size("words") - 2))
    keyed = items.where("run > 0").select("question_id", "item", F.expr("xxhash64(run, array_join(slice(words, 2, run), ' '))").alias("key"))
    docs = _docs(spark, sf_dir)
    lengths = [x.run for x in items.where("run > 0").select("run").distinct().collect()]  # RUN numbers at most
    runs = [f"transform(sequence(1, size(words) - {n - 1}), i -> xxhash64({n}, array_join(slice(words, i, {n}), ' ')))" for n in lengths]
    runs = [f"if(size(words) >= {n}, {x}, cast(array() AS array<bigint>))" for n, x in zip(lengths, runs, strict=True)]
    hashes = docs.withColumn("words", F.split("text", " ")).select("source_id", F.explode(F.expr(f"array_distinct(concat({', '.join(runs or ['cast(array() AS array<bigint>)'])}))")).alias("key"))
    likely = hashes.join(keyed, "key").select("question_id", "item", "source_id").distinct()
    found = likely.join(docs, "source_id").where(F.col("text").contains(F.col("item")))
    short = docs.join(items.where("run <= 0"), F.col("text").contains(F.col("item")))
    return found.select("question_id", "source_id").unionByName(short.select("question_id", "source_id")).distinct()


def evidence_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the documents that hold an item among its 5 best by BM25."""
    top = bm25_topk(spark, sf_dir)
    return r.recall(evidence(spark, sf_dir), top, _items(spark, sf_dir)).select("question_id", F.round("recall", 9).alias("recall"))


def lexical_retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each last turn of a conversation the 3 earlier turns with the best lexical score, latest first among equals."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("asked"), F.max_by("text", "turn").alias("question"))
    scored = turns.join(last, "conv_id").where("turn < asked").select("conv_id", "turn", F.round(lexical_score(F.col("question"), F.col("text")), 9).alias("score"))
    order = r.Window.partitionBy("conv_id").orderBy(F.col("score").desc(), F.col("turn").desc())
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")


_TOKENS = "regexp_extract_all(lower(text), '[\\x{4e00}-\\x{9fff}]|[a-z0-9]+(?:[-_.][a-z0-9]+)*')"
_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


def _bm25_sql(items: str, docs: str, sample: str = "0") -> str:
    return f"""
  d AS (SELECT {sample} AS s, source_id, {_TOKENS} AS tokens FROM ({docs})),
  st AS (SELECT s, count(*) AS n, avg(len(tokens)) AS al FROM d GROUP BY s),
  tf AS (SELECT s, source_id, len, token, count(*) AS f FROM (SELECT s, source_id, len(tokens) AS len, unnest(tokens) AS token FROM d) GROUP BY ALL),
  dfs AS (SELECT s, token, count(*) AS df FROM tf GROUP BY ALL),
  q AS (SELECT s, question_id, token, count(*) AS r FROM (SELECT {sample} AS s, question_id, unnest({_TOKENS}) AS token FROM ({items})) GROUP BY ALL),
  hit AS (
    SELECT question_id, source_id, round(sum(r * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * f * 2.5e0 / (f + 1.5e0 * (2.5e-1 + 7.5e-1 * len / greatest(al, 1e-9)))), 9) AS score
    FROM q JOIN dfs USING (s, token) JOIN st USING (s) JOIN tf USING (s, token) GROUP BY ALL),
  scored AS (SELECT a.question_id, d.source_id, coalesce(score, 0e0) AS score FROM (SELECT {sample} AS s, question_id FROM ({items})) a JOIN d USING (s) LEFT JOIN hit ON hit.question_id = a.question_id AND hit.source_id = d.source_id)"""


_ITEMS, _DOCS = "SELECT item_id AS question_id, text FROM benchmark", "SELECT doc_id AS source_id, text FROM documents"
_TOP5 = "SELECT question_id, source_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_id::VARCHAR) AS rank FROM {x}) WHERE rank <= {k}"
_DENSE = f"""
  dense AS (SELECT a.vec_id AS question_id, b.vec_id AS source_id, round({_COS.format(a="a.embedding", b="b.embedding")}, 9) AS score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""
_LABELLED = "SELECT vec_id AS source_id, label, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE label IS NOT NULL"

#: The CTE ``top``: the 5 best documents of each item.
TOP5_SQL = f"{_bm25_sql(_ITEMS, _DOCS)}, top AS ({_TOP5.format(x='scored', k=5)})"

QUERIES = {
    "bm25_topk": (bm25_topk, f"WITH {_bm25_sql(_ITEMS, _DOCS)} {_TOP5.format(x='scored', k=5)}"),
    "bm25_doc_freq": (bm25_doc_freq, f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY token"),
    "dense_topk": (dense_topk, f"WITH {_DENSE} {_TOP5.format(x='dense', k=5)}"),
    "rrf_hybrid": (
        rrf_hybrid,
        f"""WITH {_bm25_sql("SELECT label, source_id AS question_id, text FROM (" + _LABELLED + ") WHERE source_id % 20 = 0", _LABELLED, "label")}, {_DENSE},
  kept AS (SELECT dense.* FROM dense WHERE source_id IN (SELECT doc_id FROM documents) AND question_id IN (SELECT doc_id FROM documents)),
  l AS ({_TOP5.format(x="(SELECT * FROM scored WHERE question_id <> source_id)", k=20)}), v AS ({_TOP5.format(x="kept", k=20)}),
  fused AS (SELECT question_id, source_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY ALL)
{_TOP5.format(x="fused", k=10)}""",
    ),
    "evidence_recall": (
        evidence_recall,
        f"""WITH {_bm25_sql(_ITEMS, _DOCS)}, top AS ({_TOP5.format(x="scored", k=5)}),
  ev AS (SELECT item_id AS question_id, doc_id AS source_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  hits AS (SELECT question_id, avg((source_id IN (SELECT t.source_id FROM top t WHERE t.question_id = ev.question_id))::INT::DOUBLE) AS share FROM ev GROUP BY 1)
SELECT item_id AS question_id, round(coalesce(share, 1e0), 9) AS recall FROM benchmark LEFT JOIN hits ON item_id = question_id""",
    ),
    "lexical_retrieve_topk": (
        lexical_retrieve_topk,
        """WITH l AS (SELECT conv_id, max(turn) AS asked, max_by(text, turn) AS question FROM conversations GROUP BY 1),
  sets AS (SELECT c.conv_id, turn, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM conversations c JOIN l USING (conv_id) WHERE turn < asked),
  scored AS (SELECT conv_id, turn, round(len(list_intersect(q, t)) / sqrt((greatest(1, len(q)) * greatest(1, len(t)))::DOUBLE), 9) AS score FROM sets)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn DESC) AS rank FROM scored) WHERE rank <= 3""",
    ),
}
