"""Evaluation runs over conversations: a conversation asks, its turns are the candidates; answers and audits are stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import SPACE_SQL, approx_tokens
from memloom.jobs import retrieval
from memloom.operators import builder, evaluation, integrity, packing, rendering, requirements
from memloom.operators.retrieval import unit
from memloom.sources import jsonl, lookup
from memloom.sources.scratch import new_path
from memloom.sources.tables import table

SAMPLE, SEED, BUDGET, MOST = 20, 7, 200, 3


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents of each language, without replacement."""
    return evaluation.sampled(table(spark, sf_dir, "documents", "doc_id", "lang"), SAMPLE, "doc_id", SEED, "lang")


def limited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of the documents, and of it the first ones by source, language and id."""
    drawn = evaluation.sampled(table(spark, sf_dir, "documents", "doc_id", "source", "lang"), 5 * SAMPLE, "doc_id", SEED)
    return evaluation.limited(drawn, ["source", "lang", "doc_id"], SAMPLE)


def arm_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each arm reads for each conversation."""
    rank = F.when(F.col("turn") % 4 != 3, F.col("turn") * 5 % 7 + 1)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question"), F.col("turn").alias("source"), rank.alias("rank"), approx_tokens(F.col("text")).alias("cost"), (F.col("turn") % 3 == 0).alias("chosen"))
    out = evaluation.contexts(rows, BUDGET, MOST)
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


def selected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each asking vector in order of their ranks, selected and dropped; sources without a document have no block."""
    usable = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id", unit(F.col("embedding")).alias("u"))
    ranked = retrieval.dense_topk(spark, sf_dir).select(F.col("question_id").alias("question"), F.col("source_id").alias("source"), "rank")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("source"), approx_tokens(F.col("text")).alias("tokens")).where("source % 7 <> 3")
    rows = ranked.join(docs, "source", "left").withColumns({"known": F.col("tokens").isNotNull(), "cost": F.col("tokens") + 25})
    rows = rows.join(usable.withColumnsRenamed({"vec_id": "question", "u": "q"}), "question").join(usable.withColumnsRenamed({"vec_id": "source", "u": "v"}), "source")
    return packing.select_sources(rows, MOST, 900, 950).withColumn("cosine", F.round("cosine", 9))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation of at most 64 as blocks, some without a time; those of every tenth conversation are left out."""
    block = F.struct("turn", F.concat_ws(":", "conv_id", "turn").alias("source_id"), F.expr("if(turn % 3 = 1, NULL, concat('D', turn))").alias("dia_id"), F.expr("if(turn % 4 = 3, NULL, concat('day ', turn))").alias("time"), F.col("role").alias("speaker"), "text")
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("conv_id") % 10 != 7, block))).alias("blocks"), F.count(F.lit(1)).alias("n")).where("n <= 64")


def rendered_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a memory packet."""
    text = rendering.packet_text(F.col("blocks"), F.expr("if(conv_id % 2 = 0, concat('first: ', conv_id), '')"), F.expr("if(conv_id % 3 = 0, concat(' about ', conv_id, ' '), NULL)"))
    return _blocks(spark, sf_dir).select("conv_id", text.alias("text"))


def rendered_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a built memory, a statement of each turn."""
    memories = F.expr("transform(blocks, b -> named_struct('m', b.text, 'src', array(b.turn + 1, b.turn + 2)))")
    topology = F.to_json(F.struct(F.size("blocks").alias("edges"), F.transform("blocks", lambda b: b["turn"] + 1).alias("nodes")))
    return _blocks(spark, sf_dir).select("conv_id", rendering.build_text(memories, F.lit("Chain"), topology).alias("text"))


def compiler_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler inputs of the last turn of each conversation, which asks; some turns have no vector, and two cache rows speak of each."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), "turn", F.col("turn").cast("string").alias("source_id"), "role", "text")
    blocks = turns.select("sample_id", F.col("turn").alias("turn_index"), F.lit(0).alias("chunk_index"), "source_id", "text", approx_tokens(F.col("text")).alias("token_count"), (approx_tokens(F.col("text")) + 20).alias("cost"))
    last = turns.groupBy("sample_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("question"), F.max_by("role", "turn").alias("answer"))
    vector = F.struct("source_id", F.array((F.col("turn") * 1.0), F.lit(1.0)).alias("v"))
    maps = turns.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("turn") % 5 != 3, vector))).alias("vectors"))
    cache = last.join(maps, "sample_id").select("sample_id", F.concat(F.lit("q"), "turn").alias("qa_id"), "question", "vectors", F.explode(F.array(F.lit(0), F.lit(1))).alias("place"))
    cache = cache.withColumns({"model": F.when(F.col("place") == 1, "m2").otherwise(F.when(F.col("sample_id") % 2 == 0, "m1")), "vectors": F.when(F.col("place") == 1, F.transform_values("vectors", lambda k, v: F.transform(v, lambda x: x + 1))).otherwise(F.col("vectors"))})
    sources = requirements.history_sources(blocks, *requirements.frozen_vectors(cache), 6, 400, 460)
    questions = last.where("sample_id % 3 > 0").select("sample_id", F.concat(F.lit("q"), "turn").alias("qa_id"), "answer", (F.col("turn") % 5 + 1).alias("category"))
    held = sources.select("sample_id").distinct()
    rows = requirements.compiler_rows(cache.where("place = 0").join(held, "sample_id", "left_semi"), sources, questions)
    first = F.get("sources", 0)["vector"]
    return rows.select("sample_id", "qa_id", F.array_join("sources.source_id", ",").alias("sources"), F.aggregate("sources.token_count", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), F.get(first, 0).alias("first"), F.get("future_queries", 0)["answer"].alias("answer"), F.get("future_queries", 0)["category"].alias("category"))


def _answer(tries: int):
    kind = F.expr("pmod(conv_id + length(arm), 5)")

    def answer(rows: DataFrame) -> DataFrame:
        bad = F.lit(tries == 1)
        return rows.select("conv_id", "arm", F.when(bad & (kind == 0), "agent_error").otherwise("ok").alias("status"), F.when(bad & (kind == 0), "timeout").alias("error"), (~(bad & (kind == 1))).alias("usage_complete"), F.expr("(conv_id * 7 + length(arm) * 13) % 100 / 100D").alias("score"))

    return answer


def arm_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all arms of which some calls fail, a second run that answers only those, and the merged journal."""
    keys, schema, path = ["conv_id", "arm"], "conv_id long, arm string, status string, error string, usage_complete boolean, score double", new_path(spark, "journal")
    planned = evaluation.tasks(table(spark, sf_dir, "conversations", "conv_id").distinct())
    for number in (1, 2):
        evaluation.run(planned, keys, _answer(number), path, schema, number, batches=2)
    out = evaluation.results(evaluation.read_journal(spark, path, schema), keys)
    return out.select(*keys, "done", "status", "score", "try")


def _oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("cost", approx_tokens(F.col("text")))
    arm = F.explode(F.array(F.lit("gold_oracle"), F.lit("full_memory"))).alias("arm")
    rows = turns.groupBy("conv_id").agg(F.sum("cost").alias("full"), F.coalesce(F.sum(F.when(F.col("turn") % 2 == 0, F.col("cost"))), F.lit(0)).alias("gold")).select("*", arm)
    status = F.expr("CASE WHEN arm = 'gold_oracle' AND conv_id % 7 = 0 THEN 'builder_error' WHEN arm = 'full_memory' AND conv_id % 11 = 0 THEN 'agent_error' WHEN conv_id % 13 = 0 THEN 'empty_memory' ELSE 'ok' END")
    score = F.expr("(conv_id * 7 + length(arm) * 13) % 100 / 100D")
    return rows.select("conv_id", "arm", status.alias("status"), score.alias("score"), (score > 0.5).cast("double").alias("exact"), F.when(F.col("arm") == "gold_oracle", F.col("gold")).otherwise(F.col("full")).alias("tokens"))


def gold_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold sources against all sources, pair by pair."""
    return evaluation.paired_oracle(_oracle(spark, sf_dir), ["conv_id"]).withColumn("token_saving", F.round("token_saving", 9))


def gold_oracle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs in one row; failed calls are unknown, not 0."""
    out = evaluation.oracle_summary(evaluation.paired_oracle(_oracle(spark, sf_dir), ["conv_id"]))
    return out.select("n", "unknown", *(F.round(x, 9).alias(x) for x in ("gold_score", "full_score", "gold_exact", "full_exact", "token_saving")))


def teacher_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that hold each turn's text: whole, without their last brace, cut deeper, fenced, and no object."""
    whole = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("r"), "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.array(F.array("turn")).alias("packages"))).alias("requirements")))
    cut = lambda n: F.expr(f"left(w, length(w) - {n})")
    raw = F.when(F.col("k") == 0, F.col("w")).when(F.col("k") == 1, cut(1)).when(F.col("k") == 2, cut(3)).when(F.col("k") == 3, F.concat(F.lit("Here it is.\n```json\n"), "w", F.lit("\n```\n"))).otherwise(F.concat(F.lit("["), "w", F.lit("]")))
    rows = table(spark, sf_dir, "conversations").withColumns({"w": whole, "k": F.col("turn") % 5}).withColumn("raw", raw)
    out = builder.teacher_reply(rows)
    return out.select("conv_id", "turn", "repair", "error", F.expr("try_variant_get(reply, '$.requirements[0].text', 'string')").alias("text"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of documents and of conversations, a scan a table."""
    docs = integrity.violations(table(spark, sf_dir, "documents"), {
        "n_chars is the length": F.col("n_chars") == F.char_length("text"), "text is not blank": F.trim("text") != "", "language is known": F.col("lang").isin("en", "de"),
        "id is not negative": F.col("doc_id") >= 0, "up to 5000 characters": F.col("n_chars") <= 5000,
    })
    turns = integrity.violations(table(spark, sf_dir, "conversations"), {"role is user or assistant": F.col("role").isin("user", "assistant"), "up to six turns": F.col("turn") < 6, "turn has text": F.length("text") > 0})
    return docs.withColumn("table", F.lit("documents")).unionByName(turns.withColumn("table", F.lit("conversations")))


def artefact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, calls and rows of documents with planted gaps, copies and changes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"))
    calls = docs.where("doc_id % 40 <> 5").withColumn("digest", F.expr("if(doc_id % 30 = 7, sha2(digest, 256), digest)"))
    return integrity.disagreements({"requests": docs.where("doc_id % 50 <> 3"), "calls": calls, "rows": docs.unionByName(docs.where("doc_id % 60 = 9"))}, "doc_id")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a JSON-lines file of all documents, those of every twentieth id, read by their places."""
    path, index = new_path(spark, "cache"), new_path(spark, "cache-index")
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    jsonl.write_jsonl(docs, path)
    lookup.build_index(spark, path, docs.select("doc_id").schema, index)
    found = lookup.lookup(spark, path, index, docs.where("doc_id % 20 = 0").select("doc_id"))
    return found.select("doc_id", F.from_json("line", docs.schema).alias("row")).select("doc_id", "row.lang", F.sha2("row.text", 256).alias("text_sha256"))


_COST = f"greatest(1, ceil(len(list_filter(string_split_regex(text, '{SPACE_SQL}'), lambda w: w <> '')) * 1.3e0))::BIGINT"
_ORACLE = f"""t AS (SELECT conv_id, sum({_COST})::BIGINT AS f, coalesce(sum({_COST}) FILTER (turn % 2 = 0), 0)::BIGINT AS g FROM conversations GROUP BY 1),
  p AS (SELECT conv_id, CASE WHEN conv_id % 7 <> 0 THEN (conv_id * 7 + 143) % 100 / 1e2 END AS gold_score, CASE WHEN conv_id % 11 <> 0 THEN (conv_id * 7 + 143) % 100 / 1e2 END AS full_score, f, g FROM t),
  q AS (SELECT conv_id, gold_score, full_score, (gold_score > 0.5)::INT::DOUBLE AS gold_exact, (full_score > 0.5)::INT::DOUBLE AS full_exact, gold_score IS NOT NULL AND full_score IS NOT NULL AS measured, CASE WHEN f > 0 THEN 1 - g::DOUBLE / f END AS token_saving FROM p)"""
_JSON = """'{"requirements":[{"id":"r' || turn || '","text":' || to_json(coalesce(text, ''))::VARCHAR || ',"packages":[[' || turn || ']]}]}'"""

QUERIES = {
    "stratified_sample": (stratified_sample, f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || doc_id), doc_id) <= {SAMPLE}"),
    "limited_rows": (
        limited_rows,
        f"SELECT *, row_number() OVER (ORDER BY source, lang, doc_id) AS place FROM (SELECT doc_id, source, lang FROM documents ORDER BY sha256('{SEED}:' || doc_id), doc_id LIMIT {5 * SAMPLE}) QUALIFY place <= {SAMPLE}",
    ),
    "arm_contexts": (
        arm_contexts,
        f"""WITH RECURSIVE c AS (SELECT conv_id AS q, turn AS s, CASE WHEN turn % 4 <> 3 THEN turn * 5 % 7 + 1 END AS rank, {_COST} AS cost, turn % 3 = 0 AS chosen FROM conversations),
  o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, s) AS k FROM c WHERE rank IS NOT NULL),
  f AS (SELECT q, 0::BIGINT AS k, 0::BIGINT AS used, NULL::BIGINT AS s, false AS packed FROM (SELECT DISTINCT q FROM o)
    UNION ALL SELECT o.q, o.k, f.used + CASE WHEN f.used + o.cost <= {BUDGET} THEN o.cost ELSE 0 END, o.s, f.used + o.cost <= {BUDGET} FROM f JOIN o ON o.q = f.q AND o.k = f.k + 1),
  r AS (SELECT c.*, unnest({list(evaluation.ARMS)}) AS arm, coalesce(packed, false) AS packed FROM c LEFT JOIN f ON f.q = c.q AND f.s = c.s),
  x AS (SELECT *, CASE arm WHEN 'no_memory' THEN false WHEN 'full_memory' THEN rank IS NOT NULL WHEN 'naive_rag' THEN coalesce(rank <= {MOST}, false) WHEN 'rank_pack' THEN packed ELSE chosen END AS reads FROM r)
SELECT q AS question, arm, coalesce(string_agg(s::VARCHAR, ',' ORDER BY rank NULLS LAST, s) FILTER (reads), '') AS sources, coalesce(sum(cost) FILTER (reads), 0)::BIGINT AS cost FROM x GROUP BY ALL""",
    ),
    "selected_sources": (
        selected_sources,
        f"""WITH RECURSIVE {retrieval._DENSE}, top AS ({retrieval._TOP5.format(x='dense', k=5)}),
  t AS (SELECT question_id AS question, source_id AS source, rank, score, {_COST} AS tokens FROM top LEFT JOIN documents ON doc_id = source_id AND doc_id % 7 <> 3 WHERE text IS NOT NULL UNION ALL SELECT question_id, source_id, rank, score, NULL FROM top WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = source_id AND doc_id % 7 <> 3 AND text IS NOT NULL)),
  o AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY rank, source) AS k FROM t WHERE tokens IS NOT NULL),
  f AS (SELECT question, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS whole, NULL::BIGINT AS source, false AS fits FROM (SELECT DISTINCT question FROM o)
    UNION ALL SELECT o.question, o.k, f.n + ok::INT, f.used + CASE WHEN ok THEN o.tokens ELSE 0 END, f.whole + CASE WHEN ok THEN o.tokens + 25 ELSE 0 END, o.source, ok
    FROM (SELECT f.*, o.k AS k2, f.n < {MOST} AND f.used + o.tokens <= 900 AND f.whole + o.tokens + 25 <= 950 AS ok FROM f JOIN o ON o.question = f.question AND o.k = f.k + 1) f JOIN o ON o.question = f.question AND o.k = f.k2)
SELECT t.question, t.source, t.rank, coalesce(fits, false) AS selected, CASE WHEN fits THEN f.n END AS place, CASE WHEN tokens IS NOT NULL THEN score END AS cosine FROM t LEFT JOIN f ON f.question = t.question AND f.source = t.source""",
    ),
    "compiler_rows": (
        compiler_rows,
        f"""WITH RECURSIVE c AS (SELECT conv_id AS q, turn, {_COST} AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn % 5 <> 3),
  f AS (SELECT q, 0::BIGINT AS k, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS turn, 0::BIGINT AS cost, false AS ok FROM (SELECT DISTINCT q FROM c)
    UNION ALL SELECT c.q, c.k, f.n + (f.n < 6 AND f.used + c.cost <= 400 AND f.used + c.cost + 20 * (f.n + 1) <= 460)::INT, f.used + CASE WHEN f.n < 6 AND f.used + c.cost <= 400 AND f.used + c.cost + 20 * (f.n + 1) <= 460 THEN c.cost ELSE 0 END, c.turn, c.cost,
    f.n < 6 AND f.used + c.cost <= 400 AND f.used + c.cost + 20 * (f.n + 1) <= 460 FROM f JOIN c ON c.q = f.q AND c.k = f.k + 1),
  s AS (SELECT q, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS sources, sum(cost)::BIGINT AS tokens, min(turn) + 1e0 AS first FROM f WHERE ok GROUP BY 1),
  l AS (SELECT conv_id AS q, max(turn) AS turn, max_by(role, turn) AS answer FROM conversations GROUP BY 1)
SELECT s.q AS sample_id, 'q' || turn AS qa_id, sources, tokens, first, CASE WHEN s.q % 3 > 0 THEN answer END AS answer, CASE WHEN s.q % 3 > 0 THEN turn % 5 + 1 END AS category FROM s JOIN l ON l.q = s.q""",
    ),
    "rendered_packets": (
        rendered_packets,
        """WITH b AS (SELECT conv_id, string_agg('[' || (turn + 1) || '] source_id=' || conv_id || ':' || turn || ' dia_id=' || CASE WHEN turn % 3 = 1 THEN '' ELSE 'D' || turn END || ' date=' || CASE WHEN turn % 4 = 3 THEN 'unknown time' ELSE 'day ' || turn END || ' speaker=' || coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS lines
  FROM conversations GROUP BY 1 HAVING count(*) <= 64)
SELECT conv_id, 'Task-scoped memory packet.' || chr(10) || 'Use only this packet as supplied memory for the current task.' || CASE WHEN conv_id % 3 = 0 THEN chr(10) || 'about ' || conv_id ELSE '' END || chr(10) ||
  CASE WHEN conv_id % 10 = 7 THEN 'Original evidence: (empty)' ELSE 'Original evidence:' || chr(10) || lines END || chr(10) || CASE WHEN conv_id % 2 = 0 THEN 'Relationship hints:' || chr(10) || 'first: ' || conv_id ELSE 'Relationship hints: (none)' END AS text FROM b""",
    ),
    "rendered_builds": (
        rendered_builds,
        """SELECT conv_id, CASE WHEN conv_id % 10 = 7 THEN '' ELSE 'Architecture: Chain' || chr(10) || 'Topology: {"edges":' || count(*) || ',"nodes":[' || string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) || ']}' || chr(10) ||
  string_agg('- ' || coalesce(text, '') || ' [src:' || (turn + 1) || ',' || (turn + 2) || ']', chr(10) ORDER BY turn) END AS text FROM conversations GROUP BY 1 HAVING count(*) <= 64""",
    ),
    "arm_journal": (
        arm_journal,
        f"SELECT conv_id, arm, true AS done, 'ok' AS status, (conv_id * 7 + length(arm) * 13) % 100 / 1e2 AS score, CASE WHEN (conv_id + length(arm)) % 5 <= 1 THEN 2 ELSE 1 END::BIGINT AS try FROM (SELECT DISTINCT conv_id, unnest({list(evaluation.ARMS)}) AS arm FROM conversations)",
    ),
    "gold_oracle": (gold_oracle, f"WITH {_ORACLE} SELECT * REPLACE (round(token_saving, 9) AS token_saving) FROM q"),
    "gold_oracle_summary": (
        gold_oracle_summary,
        f"WITH {_ORACLE} SELECT count(*) FILTER (measured) AS n, count(*) FILTER (NOT measured) AS unknown, {', '.join(f'round(avg({x}) FILTER (measured), 9) AS {x}' for x in ('gold_score', 'full_score', 'gold_exact', 'full_exact', 'token_saving'))} FROM q",
    ),
    "teacher_replies": (
        teacher_replies,
        f"""WITH w AS (SELECT conv_id, turn, turn % 5 AS k, text, {_JSON} AS whole FROM conversations),
  r AS (SELECT *, CASE k WHEN 1 THEN left(whole, length(whole) - 1) WHEN 2 THEN left(whole, length(whole) - 3) ELSE whole END AS raw FROM w)
SELECT conv_id, turn, CASE WHEN NOT json_valid(raw) AND json_valid(raw || '}}') AND raw LIKE '%]' THEN '{builder.REPAIRED}' END AS repair, CASE WHEN k = 4 THEN 'root_not_object' WHEN NOT json_valid(raw) AND NOT (json_valid(raw || '}}') AND raw LIKE '%]') THEN 'parse_error' END AS error,
  CASE WHEN k <> 4 AND (json_valid(raw) OR json_valid(raw || '}}')) THEN coalesce(text, '') END AS text FROM r""",
    ),
    "inventory": (
        inventory,
        """SELECT 'documents' AS "table", unnest(['n_chars is the length', 'text is not blank', 'language is known', 'id is not negative', 'up to 5000 characters']) AS "constraint", unnest([count(*) - count(*) FILTER (n_chars = length(text)), count(*) - count(*) FILTER (trim(text) <> ''),
    count(*) - count(*) FILTER (lang IN ('en', 'de')), count(*) - count(*) FILTER (doc_id >= 0), count(*) - count(*) FILTER (n_chars <= 5000)]) AS violations FROM documents
UNION ALL SELECT 'conversations', unnest(['role is user or assistant', 'up to six turns', 'turn has text']), unnest([count(*) - count(*) FILTER (role IN ('user', 'assistant')), count(*) - count(*) FILTER (turn < 6), count(*) - count(*) FILTER (length(text) > 0)]) FROM conversations""",
    ),
    "cache_lookup": (cache_lookup, "SELECT doc_id, lang, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 20 = 0"),
    "artefact_check": (
        artefact_check,
        """WITH l AS (SELECT doc_id, sha256(text) AS d, 'requests' AS p FROM documents WHERE doc_id % 50 <> 3 UNION ALL SELECT doc_id, CASE WHEN doc_id % 30 = 7 THEN sha256(sha256(text)) ELSE sha256(text) END, 'calls' FROM documents WHERE doc_id % 40 <> 5
    UNION ALL SELECT doc_id, sha256(text), 'rows' FROM documents UNION ALL SELECT doc_id, sha256(text), 'rows' FROM documents WHERE doc_id % 60 = 9),
  n AS (SELECT doc_id, p, count(*) AS n FROM l GROUP BY ALL), a AS (SELECT doc_id, list_sort(list(p)) AS there, list_sort(list(p) FILTER (n > 1)) AS often FROM n GROUP BY 1), f AS (SELECT doc_id, count(DISTINCT d) > 1 AS differs FROM l GROUP BY 1)
SELECT doc_id, 'missing' AS problem, array_to_string(list_filter(['calls', 'requests', 'rows'], lambda x: NOT list_contains(there, x)), ',') AS parts FROM a WHERE len(there) < 3
UNION ALL SELECT doc_id, 'repeated', array_to_string(often, ',') FROM a WHERE len(often) > 0 UNION ALL SELECT doc_id, 'differs', array_to_string(there, ',') FROM a JOIN f USING (doc_id) WHERE differs""",
    ),
}
