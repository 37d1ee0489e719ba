"""Conversations as source blocks, question rows and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import approx_tokens, budget_chunks

#: Turns of a session, and tokens of a block.
SESSION_TURNS, BLOCK_TOKENS = 4, 256


def turns_of(conversations: DataFrame) -> DataFrame:
    """Turns with sample, session, place and dialogue id."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = conversations.withColumn("turn_index", (F.row_number().over(order) - 1).cast("long"))
    turns = turns.withColumn("session_index", F.expr(f"turn_index div {SESSION_TURNS} + 1"))
    turns = turns.withColumn("position_in_session", F.expr(f"turn_index % {SESSION_TURNS}"))
    return turns.select(
        F.col("conv_id").cast("string").alias("sample_id"),
        F.concat(F.lit("session_"), "session_index").alias("session_id"),
        "session_index",
        F.concat(F.lit("D"), "session_index", F.lit(":"), F.col("position_in_session") + 1).alias("dia_id"),
        F.col("role").alias("speaker"),
        "text",
        "turn_index",
        "position_in_session",
    )


def blocks_of(conversations: DataFrame, most: int = BLOCK_TOKENS) -> DataFrame:
    """One row per chunk of a turn; turns are counted before they are cut."""
    turns = turns_of(conversations)
    chunks = turns.select("*", F.posexplode(budget_chunks(F.col("text"), most)).alias("chunk_index", "chunk")).drop("text")
    return chunks.select(
        "sample_id", "session_id", "session_index", "dia_id",
        F.concat_ws(":", "sample_id", "dia_id", "chunk_index").alias("source_id"),
        F.col("chunk_index").cast("long"), "speaker", F.col("chunk").alias("text"), "turn_index", "position_in_session",
        approx_tokens(F.col("chunk")).alias("token_count"),
    )


def questions_of(conversations: DataFrame) -> DataFrame:
    """A question for every user turn that an assistant turn follows, with a category from its place."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = conversations.withColumns({"answer": F.lead("text").over(order), "answered_by": F.lead("role").over(order)})
    asked = turns.where("role = 'user' AND answered_by = 'assistant'")
    category = (F.col("turn") % 5 + 1).cast("long")
    return asked.select(F.col("conv_id").cast("string").alias("sample_id"), F.concat_ws(":q", "conv_id", "turn").alias("qa_id"), F.col("text").alias("question"), "answer", category.alias("category"), (category <= 4).alias("eligible_for_training"))


def canonical_evidence(text: Column) -> Column:
    """Dialogue ids named in a text without leading zeros, each once, in order."""
    found = F.regexp_extract_all(text, F.lit("D:?\\d+:\\d+"), 0)
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "^D:?0*(\\d)", "D$1"), ":0*(\\d)", ":$1"))
    return F.array_distinct(plain)


def sessions_of(records: DataFrame) -> DataFrame:
    """Turns of raw records: ``sample_id, session_id, session_index, session_datetime, position_in_session, dia_id, speaker, text, turn_index``.

    ``records``: sample_id, conversation (JSON: ``session_N`` a list of turns, ``session_N_date_time``, names of ``speaker_a`` and
    ``speaker_b``). Sessions are in order of their number; other keys and keys whose value is no list are left out. A turn
    without a dialogue id gets D<session>:<place>. turn_index counts the turns of a sample from 0.
    """
    parsed = records.select("sample_id", F.from_json("conversation", "map<string,variant>").alias("_c"))
    entries = parsed.select("sample_id", "_c", F.explode(F.map_entries("_c")).alias("_e")).where(F.expr("_e.key RLIKE '^session_[0-9]+$' AND schema_of_variant(_e.value) LIKE 'ARRAY<%'"))
    named = lambda key: F.expr(f"try_variant_get(element_at(_c, {key}), '$', 'string')")
    sessions = entries.select(
        "sample_id", F.col("_e.key").alias("session_id"), F.expr("cast(substring(_e.key, 9) AS bigint)").alias("session_index"), F.coalesce(named("concat(_e.key, '_date_time')"), F.lit("")).alias("session_datetime"),
        named("'speaker_a'").alias("_a"), named("'speaker_b'").alias("_b"), F.posexplode(F.expr("try_variant_get(_e.value, '$', 'array<variant>')")).alias("position_in_session", "_t"),
    )
    part = lambda name: F.expr(f"try_variant_get(_t, '$.{name}', 'string')")
    speaker = F.when(part("speaker") == "speaker_a", F.coalesce("_a", part("speaker"))).when(part("speaker") == "speaker_b", F.coalesce("_b", part("speaker"))).otherwise(F.coalesce(part("speaker"), F.lit("")))
    dia = F.coalesce(F.nullif(part("dia_id"), F.lit("")), F.concat(F.lit("D"), "session_index", F.lit(":"), F.col("position_in_session") + 1))
    order = Window.partitionBy("sample_id").orderBy("session_index", "position_in_session")
    rows = sessions.select("sample_id", "session_id", "session_index", "session_datetime", F.col("position_in_session").cast("long").alias("position_in_session"), dia.alias("dia_id"), speaker.alias("speaker"), F.regexp_replace(F.coalesce(part("text"), F.lit("")), "^\\s+|\\s+$", "").alias("text"))
    return rows.withColumn("turn_index", (F.row_number().over(order) - 1).cast("long"))


def record_audit(turns: DataFrame) -> DataFrame:
    """``sample_id, problem, name``: sessions without a date, dialogue ids that repeat, turns without text."""
    found = F.array_compact(F.array(F.when((F.col("session_datetime") == "") & (F.col("position_in_session") == 0), F.struct(F.lit("missing_session_date").alias("problem"), F.col("session_id").alias("name"))), F.when(F.col("text") == "", F.struct(F.lit("empty_turn").alias("problem"), F.col("dia_id").alias("name")))))
    repeated = turns.groupBy("sample_id", "dia_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sample_id", F.lit("duplicate_dia_id").alias("problem"), F.col("dia_id").alias("name"))
    return turns.select("sample_id", F.explode(found).alias("x")).select("sample_id", "x.*").unionByName(repeated)


def fallback_evidence(questions: DataFrame, blocks: DataFrame, most: int = 16) -> DataFrame:
    """The first blocks of each question's own labelled turns, for questions that retrieval found nothing for. ``questions``: sample_id, qa_id, evidence."""
    wanted = questions.select("sample_id", "qa_id", F.explode(F.array_distinct("evidence")).alias("dia_id"))
    order = Window.partitionBy("qa_id").orderBy("turn_index", "chunk_index", "source_id")
    rows = wanted.join(blocks, ["sample_id", "dia_id"]).withColumn("place", F.row_number().over(order).cast("long"))
    return rows.where(F.col("place") <= most)
