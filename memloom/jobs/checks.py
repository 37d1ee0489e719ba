"""Builder outputs, structures and the retrieval cache, with the defects that their checks must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.jobs import retrieval
from memloom.jobs.retrieval import _DENSE, _LABELLED, _TOP5, _bm25_sql
from memloom.operators import builder, cache, structure
from memloom.operators import retrieval as r
from memloom.sources.scratch import materialize
from memloom.sources.tables import table


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An output for each conversation: its turns as items, written in ten ways."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z0-9 .]", "").alias("m"))
    item = F.expr("""CASE conv_id % 10 WHEN 2 THEN concat('{"m": "', m, '"}') WHEN 3 THEN concat('{"m": " ", "src": [', turn, ']}') WHEN 4 THEN concat('{"m": "', m, '", "src": ["', turn, '"]}')
      WHEN 5 THEN concat('{"m": "', m, '", "src": [', turn, ', ', turn, ']}') WHEN 6 THEN concat('{"m": "', m, '", "src": [', turn + 50, ']}') ELSE concat('{"m": "', m, '", "src": [', turn, ']}') END""")
    units = turns.where("turn < 6").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
    whole = units.select("conv_id", F.concat(F.lit("["), F.array_join("items.item", ", "), F.lit("]")).alias("whole"), F.transform("items.turn", lambda t: t.cast("long")).alias("allowed"))
    raw = F.expr("""CASE conv_id % 10 WHEN 0 THEN concat('Here:\\n```json\\n', whole, '\\n```\\nthat is all') WHEN 1 THEN concat('See {no} json. ', whole, ' [1]') WHEN 7 THEN concat('{"items": ', whole, '}') WHEN 8 THEN substring(whole, 1, 9)
      WHEN 9 THEN concat('[', array_join(array_repeat('{"m": "x", "src": [0]}', 7), ','), ']') ELSE whole END""")
    return whole.select("conv_id", raw.alias("raw"), "allowed")


def builder_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of the outputs with its sources joined by commas, and why it is refused."""
    items = builder.checked_items(builder.parse(_outputs(spark, sf_dir))).select("conv_id", F.explode("items").alias("x"))
    good = F.col("x.reason").isNull()
    return items.select("conv_id", F.col("x.place").cast("long").alias("place"), F.when(good, F.col("x.m")).alias("m"), F.when(good, F.array_join(F.transform("x.src", lambda i: i.cast("string")), ",")).alias("src"), "x.reason")


def builder_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why whole outputs are refused."""
    return builder.checked_items(builder.parse(_outputs(spark, sf_dir))).select("conv_id", "error")


def struct_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of structures over the turns of conversations, of five architectures, good ones and ten kinds of defects."""
    units = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("unit")).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n BETWEEN 3 AND 64")
    line = "transform(sequence(1, n - 1), i -> struct(i AS parent, i + 1 AS child))"
    star = "transform(sequence(2, n), i -> struct(1 AS parent, i AS child))"
    edges = f"""CASE unit % 12 WHEN 0 THEN {line} WHEN 1 THEN reverse({line}) WHEN 2 THEN {star} WHEN 3 THEN concat({star}, array(struct(2 AS parent, 3 AS child))) WHEN 4 THEN array(struct(2 AS parent, 3 AS child), struct(3 AS parent, 2 AS child))
      WHEN 5 THEN {line} WHEN 8 THEN array(struct(1 AS parent, 1 AS child), struct(1 AS parent, 99 AS child)) WHEN 9 THEN array(struct(1 AS parent, 2 AS child), struct(1 AS parent, 2 AS child)) END"""
    groups = "CASE unit % 12 WHEN 6 THEN array(array(1, 2), sequence(3, n)) WHEN 7 THEN array(array(1, 2), array(2), cast(array() AS array<int>)) WHEN 10 THEN array(array(1)) END"
    kind = "element_at(array('Chain', 'Chain', 'Tree', 'Tree', 'Tree', 'Flat', 'Cluster', 'Cluster', 'Graph', 'Graph', 'Graph', 'Flat'), int(unit % 12) + 1)"
    made = units.select("unit", "n", F.expr(kind).alias("architecture"), F.expr("sequence(1, n)").alias("sources"), F.expr("if(unit % 12 = 11, array(1, 1, NULL), sequence(1, n))").alias("nodes"), F.expr(edges).alias("edges"), F.expr(groups).alias("groups"), F.expr("if(unit % 12 = 10, 'Tree', NULL)").alias("declared"))
    return structure.reasons(made).select("unit", F.array_join("reasons", ",").alias("reasons"))


def struct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of each conversation's turns whose edges are lists, some of which are no pairs or have an end that is no number."""
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("unit")).agg(F.count(F.lit(1)).cast("int").alias("n")).where("n <= 64")
    pairs = "transform(sequence(1, greatest(n - 1, 1)), i -> array(i, i + 1))"
    edges = F.expr(f"concat(if(n > 1, {pairs}, cast(array() AS array<array<int>>)), CASE unit % 4 WHEN 1 THEN array(array(1)) WHEN 2 THEN array(array(1, 2, 3)) WHEN 3 THEN array(array(1, int(NULL))) ELSE cast(array() AS array<array<int>>) END)")
    made = n.select("unit", "n", F.lit("Chain").alias("architecture"), F.expr("sequence(1, n)").alias("sources"), F.expr("sequence(1, n)").alias("nodes"), edges.alias("edges"), F.expr("cast(array() AS array<array<int>>)").alias("groups"), F.lit(None).cast("string").alias("declared"))
    return structure.reasons(made).select("unit", F.array_join("reasons", ",").alias("reasons"))


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cache rows of labelled documents that ask by text and by vector, and the questions; evidence are two neighbours by id."""
    vectors = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("source_id"), "label")
    docs = materialize(retrieval._docs(spark, sf_dir).join(vectors, "source_id"), "labelled")
    asked = docs.where("source_id % 20 = 0").select("label", F.col("source_id").alias("question_id"), "text")
    lexical = r.bm25_top_k(asked, docs, 10, "label", itself=False, blocks=True).select("question_id", "source_id", "rank")
    dense = r.top_k(retrieval._dense(spark, sf_dir, 10, docs.select("source_id").distinct()), 10, "question_id").select("question_id", "source_id", "rank")
    evidence = asked.where("question_id % 60 <> 0").select("question_id", F.explode(F.expr("array(question_id + 1, question_id + 5, question_id + 10)")).alias("source_id"))
    return cache.rows_of(r.fuse(lexical, dense, 10, "question_id"), lexical, dense, evidence, asked, "question_id"), asked


def retrieval_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache rows with arrays and maps written as texts."""
    rows, _ = _cache(spark, sf_dir)
    ids = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ",")
    ranks = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return rows.select("question_id", ids("source_ids").alias("source_ids"), F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x), 6).alias("score_sum"), ranks("bm25_rank").alias("bm25_rank"), ranks("dense_rank").alias("dense_rank"), F.round("evidence_recall", 9).alias("evidence_recall"))


def cache_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a cache of turns of which some are repeated, missing, unknown or have a score that isn't finite."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    rows = turns.where("turn % 5 <> 4").withColumn("_c", F.expr("explode(sequence(0, if(turn % 7 = 6, 1, 0)))")).select("conv_id", F.expr("if(conv_id % 9 = 8, turn + 1000, turn)").alias("turn"), F.expr("array(turn, turn + 1)").alias("source_ids"), F.expr("if(conv_id % 11 = 3 AND turn = 1, array(1D, double('NaN')), array(1D, 0.5D))").alias("scores"))
    return cache.problems(rows, turns, "conv_id", "turn")


_REFUSED = "CASE conv_id % 10 WHEN 2 THEN 'invalid_fields' WHEN 3 THEN 'empty_memory' WHEN 4 THEN 'invalid_src' WHEN 5 THEN 'src_out_of_input' WHEN 6 THEN 'src_out_of_input' END"
_HYBRID = f"""{_bm25_sql("SELECT label, source_id AS question_id, text FROM (" + _LABELLED + ") WHERE source_id % 20 = 0", _LABELLED, "label")}, {_DENSE},
  kept AS (SELECT dense.* FROM dense WHERE source_id IN (SELECT doc_id FROM documents) AND question_id IN (SELECT doc_id FROM documents)),
  l AS ({_TOP5.format(x="(SELECT * FROM scored WHERE question_id <> source_id)", k=10)}), v AS ({_TOP5.format(x="kept", k=10)}),
  fused AS (SELECT question_id, source_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY ALL),
  f AS ({_TOP5.format(x="fused", k=10)})"""

QUERIES = {
    "struct_edges": (struct_edges, "SELECT conv_id AS unit, CASE WHEN conv_id % 4 IN (1, 2) THEN 'edge_invalid' WHEN conv_id % 4 = 3 THEN 'edge_not_integer' ELSE '' END AS reasons FROM conversations GROUP BY 1 HAVING count(*) <= 64"),
    "builder_items": (
        builder_items,
        rf"""SELECT conv_id, turn AS place, CASE WHEN reason IS NULL THEN m END AS m, CASE WHEN reason IS NULL THEN turn::VARCHAR END AS src, reason
FROM (SELECT *, regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .]', '', 'g'), '^\s+|\s+$', '', 'g') AS m, {_REFUSED} AS reason FROM conversations WHERE turn < 6 AND conv_id % 10 < 7)""",
    ),
    "builder_errors": (builder_errors, "SELECT conv_id, CASE conv_id % 10 WHEN 7 THEN 'root_not_array' WHEN 8 THEN 'parse_error' WHEN 9 THEN 'too_many_memories' END AS error FROM conversations WHERE turn < 6 GROUP BY 1"),
    "struct_reasons": (
        struct_reasons,
        """SELECT unit, CASE unit % 12 WHEN 1 THEN 'chain_edges_not_ordered' WHEN 3 THEN concat_ws(',', CASE WHEN n >= 3 THEN 'tree_multiple_parents' END, 'tree_must_have_one_root')
  WHEN 4 THEN concat_ws(',', CASE WHEN n <> 3 THEN 'tree_must_have_one_root' END, CASE WHEN n <> 3 THEN 'tree_root_count' END, 'tree_cycle') WHEN 5 THEN 'flat_has_edges'
  WHEN 7 THEN concat_ws(',', 'cluster_empty_group', 'cluster_groups_overlap', CASE WHEN n > 2 THEN 'cluster_groups_do_not_cover_sources' END) WHEN 8 THEN 'edge_self_loop,edge_out_of_sources' WHEN 9 THEN 'duplicate_edges'
  WHEN 10 THEN 'structure_architecture_mismatch,non_cluster_group_mismatch' WHEN 11 THEN 'structure_nodes_not_integer,structure_nodes_do_not_match_sources,structure_nodes_duplicate' ELSE '' END AS reasons
FROM (SELECT conv_id AS unit, count(*) AS n FROM conversations GROUP BY 1) WHERE n BETWEEN 3 AND 64""",
    ),
    "retrieval_cache": (
        retrieval_cache,
        f"""WITH {_HYBRID}, g AS (SELECT question_id, string_agg(source_id::VARCHAR, ',' ORDER BY rank) AS source_ids, round(sum(score), 6) AS score_sum, list(source_id) AS ids FROM f GROUP BY 1),
  b AS (SELECT question_id, string_agg(source_id || ':' || rank, ',' ORDER BY source_id) AS bm25_rank FROM l GROUP BY 1), dr AS (SELECT question_id, string_agg(source_id || ':' || rank, ',' ORDER BY source_id) AS dense_rank FROM v GROUP BY 1)
SELECT g.question_id, source_ids, score_sum, bm25_rank, dense_rank, CASE WHEN g.question_id % 60 = 0 THEN 1e0 ELSE round(len(list_intersect(ids, [g.question_id + 1, g.question_id + 5, g.question_id + 10])) / 3e0, 9) END AS evidence_recall
FROM g JOIN b ON b.question_id = g.question_id JOIN dr ON dr.question_id = g.question_id""",
    ),
    "cache_problems": (
        cache_problems,
        """WITH k AS (SELECT conv_id, CASE WHEN conv_id % 9 = 8 THEN turn + 1000 ELSE turn END AS turn, turn AS t FROM conversations WHERE turn % 5 <> 4)
SELECT conv_id, turn, 'repeated' AS problem FROM k WHERE t % 7 = 6 UNION ALL SELECT conv_id, turn, 'unknown' FROM k WHERE conv_id % 9 = 8 UNION ALL SELECT conv_id, turn, 'scores' FROM k WHERE conv_id % 11 = 3 AND t = 1
UNION ALL SELECT conv_id, turn, 'missing' FROM conversations WHERE turn % 5 = 4 OR conv_id % 9 = 8""",
    ),
}
