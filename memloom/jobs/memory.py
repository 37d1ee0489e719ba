"""Blocks, structures and packing over all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.text import SPACE_SQL, approx_tokens
from memloom.operators import annotation, packing, structure
from memloom.operators import blocks as b
from memloom.sources.tables import table


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def blocks_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source blocks of all conversations."""
    return b.blocks_of(_conversations(spark, sf_dir))


def block_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: turns, empty texts, repeated places, turns in several blocks."""
    turns = _conversations(spark, sf_dir)
    places = turns.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"), F.count_if(approx_tokens(F.col("text")) > b.BLOCK_TOKENS).alias("long"))
    return places.groupBy("conv_id").agg(F.sum("n").alias("turns"), F.sum("empty").alias("empty_texts"), F.count_if(F.col("n") > 1).alias("repeated_places"), F.sum("long").alias("long_turns"))


def questions_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows of all conversations."""
    return b.questions_of(_conversations(spark, sf_dir))


def category_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by category, and how many may train."""
    return b.questions_of(_conversations(spark, sf_dir)).groupBy("category").agg(F.count(F.lit(1)).alias("questions"), F.count_if("eligible_for_training").alias("eligible"))


def split_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the training split; a conversation belongs to one split as a whole."""
    questions = b.questions_of(_conversations(spark, sf_dir))
    train = _conversations(spark, sf_dir).select(F.col("conv_id")).distinct().where("conv_id % 10 < 6").select(F.col("conv_id").cast("string").alias("sample_id"))
    return questions.join(train, "sample_id", "left_semi").select("sample_id", "qa_id", "category")


def evidence_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue ids in messy evidence texts, mapped to known ids; unknown ones keep their canonical form."""
    turns = b.turns_of(_conversations(spark, sf_dir))
    messy = F.concat(F.lit("D0"), "session_index", F.lit(":00"), F.col("position_in_session") + 1, F.lit("; D:"), "session_index", F.lit(":"), F.col("position_in_session") + 1, F.lit(" and D9:"), F.col("turn_index") + 90)
    named = turns.select("sample_id", "turn_index", F.posexplode(b.canonical_evidence(messy)).alias("place", "dia_id"))
    known = turns.select("sample_id", "dia_id").withColumn("known", F.lit(True))
    return named.join(known, ["sample_id", "dia_id"], "left").select("sample_id", "turn_index", F.col("place").cast("long").alias("place"), "dia_id", F.coalesce("known", F.lit(False)).alias("known"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = F.when(F.col("turn") % 5 != 4, F.expr("turn div 3"))
    return _conversations(spark, sf_dir).select(F.col("conv_id").alias("unit"), (F.col("turn") + 1).alias("id"), session.alias("session"))


def struct_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain edges."""
    return structure.chain(_nodes(spark, sf_dir))


def struct_tree_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree edges."""
    return structure.tree(_nodes(spark, sf_dir))


def struct_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges."""
    return structure.graph(_nodes(spark, sf_dir))


def struct_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster groups, ids joined by commas."""
    return structure.cluster(_nodes(spark, sf_dir)).select("unit", "group_index", "name", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def struct_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons why a unit's graph edges are no tree."""
    nodes = _nodes(spark, sf_dir)
    return structure.tree_reasons(nodes, structure.graph(nodes)).select("unit", F.array_join("reasons", "; ").alias("reasons"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations(spark, sf_dir).select("conv_id", "turn", approx_tokens(F.col("text")).alias("cost"))


def rank_pack_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns admitted in order under a budget of 256 tokens."""
    return packing.admit(_costs(spark, sf_dir), "conv_id", ["turn"], {"cost": 256})


def select_sources_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns admitted from the last one back under caps on count, body and full input."""
    items = _costs(spark, sf_dir).select("conv_id", (-F.col("turn")).alias("back"), F.lit(1).alias("blocks"), F.col("cost").alias("body"), (F.col("cost") + 8).alias("full"))
    return packing.admit(items, "conv_id", ["back"], {"blocks": 3, "body": 400, "full": 420})


def history_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks before the last turn admitted in order of session, turn and chunk under caps on count and tokens."""
    found = b.blocks_of(_conversations(spark, sf_dir), 64)
    last = found.groupBy("sample_id").agg(F.max("turn_index").alias("last"))
    items = found.join(last, "sample_id").where("turn_index < last").withColumn("blocks", F.lit(1))
    return packing.admit(items, "sample_id", ["session_index", "turn_index", "chunk_index", "source_id"], {"blocks": 6, "token_count": 300})


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw nested records of sessions of three turns, with an alias, dates that some lack, and keys that are no sessions."""
    turns = _conversations(spark, sf_dir).withColumn("s", F.expr("turn div 3 * 5 + 1"))
    turn = F.struct(F.expr("if(turn % 4 = 3, NULL, concat('T', turn div 2))").alias("dia_id"), F.expr("CASE role WHEN 'user' THEN 'speaker_a' ELSE role END").alias("speaker"), F.expr("if(turn % 11 = 7, ' ', text)").alias("text"))
    sessions = turns.groupBy("conv_id", "s").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts")).select("conv_id", "s", F.to_json("ts.t").alias("turns"))
    parts = F.concat(F.lit('"session_'), "s", F.lit('":'), "turns", F.expr("if(s % 2 = 1 AND conv_id % 3 = 0, '', concat(',\"session_', s, '_date_time\":\"day ', s, '\"'))"))
    whole = sessions.groupBy("conv_id").agg(F.sort_array(F.collect_list(parts)).alias("parts"))
    return whole.select(F.col("conv_id").cast("string").alias("sample_id"), F.concat(F.lit('{"speaker_a":"Ann","session_9":"none","sessions":[1],'), F.array_join("parts", ","), F.lit("}")).alias("conversation"))


def record_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of raw nested records."""
    return b.sessions_of(_records(spark, sf_dir))


def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the raw records lack or repeat."""
    return b.record_audit(b.sessions_of(_records(spark, sf_dir)))


def fallback_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the labelled turns (their own and the one before the last) of every question."""
    turns = _conversations(spark, sf_dir)
    questions = b.questions_of(turns).withColumn("turn", F.expr("cast(split(qa_id, ':q')[1] AS bigint)")).withColumn("evidence", F.expr("array(concat('D', turn div 4 + 1, ':', turn % 4 + 1), concat('D', (turn - 1) div 4 + 1, ':', (turn - 1) % 4 + 1), 'D99:9')"))
    return b.fallback_evidence(questions, b.blocks_of(turns, 64), 3).select("qa_id", "source_id", "place")


def write_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each conversation that a write takes in order of turn and chunk, under caps on count, tokens and full input."""
    items = b.blocks_of(_conversations(spark, sf_dir), 64).select("sample_id", "turn_index", "chunk_index", "source_id", F.lit(1).alias("blocks"), "token_count", (F.col("token_count") + 12).alias("input"))
    return packing.admit(items, "sample_id", ["turn_index", "chunk_index", "source_id"], {"blocks": 5, "token_count": 250, "input": 270})


def annotation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons why made-up annotations of the conversations are not valid."""
    units = _conversations(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    shape = F.expr("""CASE conv_id % 6 WHEN 0 THEN array(named_struct('id', 'a', 'packages', array(array(1L, 2L), array(n))))
      WHEN 1 THEN array(named_struct('id', 'a', 'packages', array(array(1L))), named_struct('id', 'a', 'packages', array(array(1L))))
      WHEN 2 THEN array(named_struct('id', 'a', 'packages', array(array(n + 1))))
      WHEN 3 THEN array(named_struct('id', 'a', 'packages', array(array(1L, 1L))))
      WHEN 4 THEN transform(sequence(1, 7), k -> named_struct('id', string(k), 'packages', array(array(1L)))) END""")
    return units.withColumn("requirements", shape).select("conv_id", annotation.annotation_reason("requirements", "n").alias("reason"))


def normalized_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of turns: given ones kept where a conversation's are positive and differ, else all renumbered."""
    rows = _conversations(spark, sf_dir).select("conv_id", "turn", F.expr("if(conv_id % 3 = 0, turn div 2, turn + 10)").alias("given"))
    return annotation.normalize_sources(rows, "conv_id", ["turn"], "given").select("conv_id", "turn", "id")


_WORDS = "list_filter(string_split_regex({x}, '" + SPACE_SQL.replace("{", "{{").replace("}", "}}") + "'), lambda w: w <> '')"
_TOKENS = "greatest(1, ceil(len(" + _WORDS + ") * 1.3e0))::BIGINT"
_TURNS = """t AS (SELECT *, turn_index // 4 + 1 AS session_index, turn_index % 4 AS position_in_session, 'D' || (turn_index // 4 + 1) || ':' || (turn_index % 4 + 1) AS dia_id
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index FROM conversations))"""


def _blocks(words: int) -> str:
    return f"""{_TURNS}, w AS (SELECT *, {_WORDS.format(x="text")} AS words FROM t),
  c AS (SELECT *, array_to_string(words[i * {words} + 1:i * {words} + {words}], ' ') AS chunk FROM (SELECT *, unnest(range(0, greatest(1, ceil(len(words) / {words}.0)::BIGINT))) AS i FROM w)),
  blocks AS (SELECT conv_id::VARCHAR AS sample_id, 'session_' || session_index AS session_id, session_index, dia_id, conv_id || ':' || dia_id || ':' || i AS source_id, i AS chunk_index, role AS speaker, chunk AS text, turn_index, position_in_session, {_TOKENS.format(x="chunk")} AS token_count FROM c)"""


_QUESTIONS = """q AS (SELECT conv_id::VARCHAR AS sample_id, conv_id || ':q' || turn AS qa_id, text AS question, answer, turn % 5 + 1 AS category, turn % 5 + 1 <= 4 AS eligible_for_training
  FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS by_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND by_role = 'assistant')"""
_NODES = "n AS (SELECT conv_id AS unit, turn + 1 AS id, CASE WHEN turn % 5 <> 4 THEN turn // 3 END AS session FROM conversations)"


_RECORD_TURNS = r"""rt AS (SELECT conv_id::VARCHAR AS sample_id, 'session_' || s AS session_id, s AS session_index, CASE WHEN s % 2 = 1 AND conv_id % 3 = 0 THEN '' ELSE 'day ' || s END AS session_datetime, turn % 3 AS position_in_session,
  CASE WHEN turn % 4 = 3 THEN 'D' || s || ':' || (turn % 3 + 1) ELSE 'T' || (turn // 2) END AS dia_id, CASE role WHEN 'user' THEN 'Ann' ELSE role END AS speaker, CASE WHEN turn % 11 = 7 THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS text, turn AS turn_index
  FROM (SELECT *, turn // 3 * 5 + 1 AS s FROM conversations))"""


def _fold(items: str, unit: str, order: list[str], costs: dict[str, int]) -> str:
    """The fold as a recursive CTE over numbered items."""
    by, cols = ", ".join(order), ", ".join([*order, *costs])
    first = " AND ".join(f"{c} <= {cap}" for c, cap in costs.items())
    fits = " AND ".join(f"f.t_{c} + i.{c} <= {cap}" for c, cap in costs.items())
    return f"""WITH RECURSIVE {items},
  i AS (SELECT {unit}, {cols}, row_number() OVER (PARTITION BY {unit} ORDER BY {by}) AS k FROM items),
  f AS (
    SELECT {unit}, k, {cols}, {first} AS admitted, {", ".join(f"CASE WHEN {first} THEN {c} ELSE 0 END AS t_{c}" for c in costs)} FROM i WHERE k = 1
    UNION ALL
    SELECT i.{unit}, i.k, {", ".join(f"i.{c}" for c in [*order, *costs])}, {fits}, {", ".join(f"f.t_{c} + CASE WHEN {fits} THEN i.{c} ELSE 0 END" for c in costs)} FROM f JOIN i ON i.{unit} = f.{unit} AND i.k = f.k + 1)
SELECT {unit}, {cols}, admitted FROM f"""


_COSTS = "c AS (SELECT conv_id, turn, " + _TOKENS.format(x="text") + " AS cost FROM conversations)"

QUERIES = {
    "blocks_from_conversations": (blocks_from_conversations, f"WITH {_blocks(196)} SELECT * FROM blocks"),
    "block_audit": (
        block_audit,
        f"""WITH p AS (SELECT conv_id, turn, count(*) AS n, count(*) FILTER (WHERE trim(coalesce(text, '')) = '') AS empty, count(*) FILTER (WHERE {_TOKENS.format(x="text")} > 256) AS long FROM conversations GROUP BY ALL)
SELECT conv_id, sum(n)::BIGINT AS turns, sum(empty)::BIGINT AS empty_texts, count(*) FILTER (WHERE n > 1) AS repeated_places, sum(long)::BIGINT AS long_turns FROM p GROUP BY 1""",
    ),
    "questions_from_conversations": (questions_from_conversations, f"WITH {_QUESTIONS} SELECT * FROM q"),
    "category_audit": (category_audit, f"WITH {_QUESTIONS} SELECT category, count(*) AS questions, count(*) FILTER (WHERE eligible_for_training) AS eligible FROM q GROUP BY 1"),
    "split_semi_join": (split_semi_join, f"WITH {_QUESTIONS} SELECT sample_id, qa_id, category FROM q WHERE sample_id IN (SELECT conv_id::VARCHAR FROM conversations WHERE conv_id % 10 < 6)"),
    "evidence_normalisation": (
        evidence_normalisation,
        f"""WITH {_TURNS}, e AS (SELECT conv_id, turn_index, list_value(dia_id, 'D9:' || (turn_index + 90)) AS ids FROM t),
  x AS (SELECT conv_id, turn_index, i - 1 AS place, ids[i] AS dia_id FROM (SELECT *, unnest(range(1, 3)) AS i FROM e))
SELECT conv_id::VARCHAR AS sample_id, turn_index, place, dia_id, EXISTS (SELECT 1 FROM t WHERE t.conv_id = x.conv_id AND t.dia_id = x.dia_id) AS known FROM x""",
    ),
    "record_turns": (record_turns, f"WITH {_RECORD_TURNS} SELECT sample_id, session_id, session_index, session_datetime, position_in_session, dia_id, speaker, text, turn_index FROM rt"),
    "record_audit": (
        record_audit,
        f"""WITH {_RECORD_TURNS} SELECT sample_id, 'missing_session_date' AS problem, session_id AS name FROM rt WHERE session_datetime = '' AND position_in_session = 0 UNION ALL SELECT sample_id, 'empty_turn', dia_id FROM rt WHERE text = ''
UNION ALL SELECT sample_id, 'duplicate_dia_id', dia_id FROM rt GROUP BY ALL HAVING count(*) > 1""",
    ),
    "fallback_evidence": (
        fallback_evidence,
        f"""WITH {_blocks(49)}, {_QUESTIONS}, w AS (SELECT sample_id, qa_id, unnest([n, n - 1]) AS turn_index FROM (SELECT *, split_part(qa_id, ':q', 2)::BIGINT AS n FROM q))
SELECT qa_id, source_id, place FROM (SELECT qa_id, source_id, row_number() OVER (PARTITION BY qa_id ORDER BY b.turn_index, chunk_index, source_id) AS place FROM w JOIN blocks b ON b.sample_id = w.sample_id AND b.turn_index = w.turn_index) WHERE place <= 3""".replace("w AS (SELECT sample_id", "wt AS (SELECT sample_id").replace("FROM w JOIN", "FROM wt w JOIN"),
    ),
    "write_candidates": (
        write_candidates,
        _fold(f'{_blocks(49)}, items AS (SELECT sample_id, turn_index, chunk_index, source_id, 1::BIGINT AS blocks, token_count, token_count + 12 AS "input" FROM blocks)', "sample_id", ["turn_index", "chunk_index", "source_id"], {"blocks": 5, "token_count": 250, "input": 270}),
    ),
    "annotation_check": (
        annotation_check,
        """SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN CASE WHEN n < 2 THEN 'unknown source' END WHEN 1 THEN 'repeated requirement' WHEN 2 THEN 'unknown source' WHEN 3 THEN 'empty or repeated sources' WHEN 4 THEN 'too many requirements' ELSE 'no requirements' END AS reason
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""",
    ),
    "normalized_sources": (
        normalized_sources,
        """WITH g AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN turn // 2 ELSE turn + 10 END AS given FROM conversations),
  f AS (SELECT conv_id, min(given) > 0 AND count(DISTINCT given) = count(*) AS fine FROM g GROUP BY 1)
SELECT g.conv_id, turn, CASE WHEN fine THEN given ELSE row_number() OVER (PARTITION BY g.conv_id ORDER BY turn) END AS id FROM g JOIN f ON g.conv_id = f.conv_id""",
    ),
    "struct_chain": (struct_chain, f"WITH {_NODES} SELECT * FROM (SELECT unit, id AS parent, lead(id) OVER (PARTITION BY unit ORDER BY id) AS child FROM n) WHERE child IS NOT NULL"),
    "struct_tree_asof": (struct_tree_asof, f"WITH {_NODES} SELECT * FROM (SELECT unit, coalesce(lag(id) OVER (PARTITION BY unit, session ORDER BY id), min(id) OVER (PARTITION BY unit)) AS parent, id AS child FROM n) WHERE parent <> child"),
    "struct_graph": (struct_graph, f"WITH {_NODES} SELECT unit, parent, child FROM (SELECT unit, id AS parent, lead(id) OVER w AS child, session, lead(session) OVER w AS s2 FROM n WINDOW w AS (PARTITION BY unit ORDER BY id)) WHERE child IS NOT NULL AND session IS NOT DISTINCT FROM s2"),
    "struct_cluster": (
        struct_cluster,
        f"""WITH {_NODES}, g AS (SELECT unit, coalesce(session::VARCHAR, '__unknown__') AS name, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM n GROUP BY ALL)
SELECT unit, row_number() OVER (PARTITION BY unit ORDER BY name) AS group_index, name, ids FROM g""",
    ),
    "struct_validate": (
        struct_validate,
        f"""WITH {_NODES}, e AS (SELECT unit, child FROM (SELECT unit, lead(id) OVER w AS child, session, lead(session) OVER w AS s2 FROM n WINDOW w AS (PARTITION BY unit ORDER BY id)) WHERE child IS NOT NULL AND session IS NOT DISTINCT FROM s2),
  c AS (SELECT unit, count(*) AS nodes, (SELECT count(*) FROM e WHERE e.unit = n.unit) AS edges FROM n GROUP BY unit)
SELECT unit, concat_ws('; ', CASE WHEN edges <> nodes - 1 THEN 'edge count' END, CASE WHEN nodes - edges <> 1 THEN 'roots' END) AS reasons FROM c""",
    ),
    "rank_pack_fold": (rank_pack_fold, _fold(f"{_COSTS}, items AS (SELECT * FROM c)", "conv_id", ["turn"], {"cost": 256})),
    "select_sources_fold": (select_sources_fold, _fold(f"{_COSTS}, items AS (SELECT conv_id, -turn AS back, 1::BIGINT AS blocks, cost AS body, cost + 8 AS \"full\" FROM c)".replace('"full"', '"full"'), "conv_id", ["back"], {"blocks": 3, "body": 400, '"full"': 420}).replace('t_"full"', "t_full")),
    "history_candidates": (history_candidates, _fold(f"{_blocks(49)}, l AS (SELECT sample_id, max(turn_index) AS last FROM blocks GROUP BY 1), items AS (SELECT blocks.*, 1::BIGINT AS blocks FROM blocks JOIN l USING (sample_id) WHERE turn_index < last)", "sample_id", ["session_index", "turn_index", "chunk_index", "source_id"], {"blocks": 6, "token_count": 300})),
}
