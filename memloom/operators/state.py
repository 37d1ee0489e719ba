"""Keyed memory state in batch: journals, upserts, first and last rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import lexical_score

#: Sources of a write unit at most, earlier ones taken beside the fresh ones, and entries that a read returns.
MAX_SOURCES, NEIGHBOURHOOD, TOP_K = 64, 16, 8


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, as one aggregate."""
    others = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("row"))
    return first.select(*keys, "row.*")


def merge_journal(rows: DataFrame, keys: list[str], order: str, done: Column) -> DataFrame:
    """For each key the first completed row, else the last row; ``done`` tells which."""
    others = [c for c in rows.columns if c not in keys]
    row = F.struct(*others)
    merged = rows.groupBy(*keys).agg(F.min_by(F.when(done, row), F.when(done, F.col(order))).alias("good"), F.max_by(row, order).alias("last"))
    return merged.select(*keys, F.col("good").isNotNull().alias("done"), F.coalesce("good", "last").alias("row")).select(*keys, "done", "row.*")


def upsert(writes: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """State after all writes: the last value of each key stands at the key's first place; ``version`` counts its writes."""
    return writes.groupBy(key).agg(F.min(order).alias("place"), F.max_by(value, order).alias(value), F.count(F.lit(1)).alias("version"))


def entry_key(text: Column, src: Column) -> Column:
    """What tells entries apart: their sorted sources; for an entry without sources its text in lower case with single spaces."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, "^\\s+|\\s+$", "")), "\\s+", " ")
    return F.when(F.size(src) > 0, F.concat(F.lit("provenance:"), F.to_json(F.array_sort(src)))).otherwise(F.concat(F.lit("text:"), plain))


def entries_after(writes: DataFrame, *more: str) -> DataFrame:
    """The entries of each memory after all writes: ``memory, entry, m, src, version``, and the columns ``more`` of the last write.

    ``writes``: memory, version (number of the batch), place (order of all writes), m (statement), src (array
    of source ids as strings, may be null). An entry of the same sources replaces the one before it where that stands, others are appended;
    entry numbers them from 0. Empty statements are no entries. One aggregate per memory and key.
    """
    rows = writes.select("memory", "version", "place", *more, F.regexp_replace("m", "^\\s+|\\s+$", "").alias("m"), F.array_sort(F.coalesce("src", F.array().cast("array<string>"))).alias("src")).where("m <> ''")
    keyed = rows.groupBy("memory", entry_key(F.col("m"), F.col("src")).alias("key")).agg(F.min("place").alias("first"), F.max_by(F.struct("m", "src", "version", *more), "place").alias("row"))
    place = F.row_number().over(Window.partitionBy("memory").orderBy("first")) - 1
    return keyed.select("memory", place.cast("long").alias("entry"), "row.*")


def sources_after(writes: DataFrame) -> DataFrame:
    """``memory, source_id, text``: the last text written for each source. ``writes``: memory, source_id, place, text."""
    return writes.groupBy("memory", "source_id").agg(F.max_by("text", "place").alias("text"))


def retrieve(entries: DataFrame, sources: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k entries of its memory with the best lexical score for each query, the later one first among equals.

    An entry is scored with its statement and the texts of its sources in order of their ids. ``queries``: memory, query_id, query.
    Returns memory, query_id, entry, m, src, score, rank.
    """
    spread = entries.select("memory", "entry", F.explode("src").alias("source_id")).join(sources, ["memory", "source_id"])
    texts = spread.groupBy("memory", "entry").agg(F.array_sort(F.collect_list(F.struct("source_id", F.coalesce("text", F.lit("")).alias("text")))).alias("texts"))
    whole = entries.join(texts, ["memory", "entry"], "left").withColumn("_text", F.concat_ws(" ", "m", F.array_join(F.col("texts.text"), " ")))
    scored = queries.join(whole, "memory").withColumn("score", lexical_score(F.coalesce("query", F.lit("")), F.col("_text")))
    order = Window.partitionBy("memory", "query_id").orderBy(F.col("score").desc(), F.col("entry").desc())
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return ranked.select("memory", "query_id", "entry", "m", "src", "score", "rank")


def render(retrieved: DataFrame) -> DataFrame:
    """``memory, query_id, text``: what was retrieved, a numbered line for each entry behind a heading."""
    # The heading, and the form of a line.
    line = F.format_string("[%d] %s [src:%s]", "rank", "m", F.array_join("src", ","))
    lines = retrieved.groupBy("memory", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return lines.select("memory", "query_id", F.concat_ws("\n", F.lit("Persistent memory:"), F.col("lines.line")).alias("text"))


def candidate_sources(sources: DataFrame, neighbourhood: int = NEIGHBOURHOOD, most: int = MAX_SOURCES) -> DataFrame:
    """What a write unit may select from: its fresh sources in order, then the best earlier ones, numbered from 1 by ``id``.

    ``sources``: unit, source_id, place, text, fresh (boolean). Earlier sources are ranked by lexical score against all fresh texts,
    then latest first, then by id; of a source that appears twice the first stays. Adds overlap (null for fresh ones).
    """
    asked = sources.where("fresh").groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x.text), " ").alias("_asked"))
    old = sources.where("NOT fresh").join(asked, "unit").withColumn("overlap", lexical_score(F.col("_asked"), F.coalesce("text", F.lit("")))).drop("_asked")
    order = Window.partitionBy("unit").orderBy(F.col("overlap").desc(), F.col("place").desc(), "source_id")
    old = old.withColumn("_at", F.row_number().over(order).cast("long")).where(F.col("_at") <= neighbourhood)
    both = sources.where("fresh").withColumns({"overlap": F.lit(None).cast("double"), "_at": F.col("place")}).unionByName(old).withColumn("_part", F.when(F.col("fresh"), 0).otherwise(1))
    first = Window.partitionBy("unit", "source_id").orderBy("_part", "_at")
    number = F.row_number().over(Window.partitionBy("unit").orderBy("_part", "_at", "source_id")).cast("long")
    kept = both.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("id", number).where(F.col("id") <= most)
    return kept.drop("_n", "_at", "_part")


def digest(row: Column | str) -> Column:
    """SHA-256 of a struct as JSON, null fields kept: the identity of a row or request."""
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def replay(requests: DataFrame, saved: DataFrame, order: str) -> DataFrame:
    """Adds ``action`` to requests (identity): ``replay`` of a saved success, ``blocked`` where only a call whose end is unknown is saved, else ``call``.

    ``saved``: identity, status (success, failed, in_flight, outcome_unknown), order. One aggregate of the saved calls, one join.
    """
    known = saved.groupBy("identity").agg(F.min_by("status", F.when(F.col("status") == "success", F.col(order))).alias("done"), F.max(F.col("status").isin("in_flight", "outcome_unknown")).alias("open"))
    action = F.when(F.col("done").isNotNull(), "replay").when(F.col("open"), "blocked").otherwise("call")
    return requests.join(known, "identity", "left").withColumn("action", action).drop("done", "open")


def latest_block(calls: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Of the calls refused for quota (status 402) whose reset is after ``now``, the one of each key that began last."""
    open_ = calls.where((F.col("http_status") == 402) & (F.col("reset") > now)).drop("http_status")
    others = [c for c in open_.columns if c not in keys]
    return open_.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("started", "event_id")).alias("row")).select(*keys, "row.*")


def claimed_twice(claims: DataFrame, member: str, group: str) -> DataFrame:
    """Members that several groups claim, with the sorted names of the groups."""
    once = claims.select(member, group).distinct()
    return once.groupBy(member).agg(F.array_sort(F.collect_list(group)).alias("groups")).where(F.size("groups") > 1)


# Names of fields that hold secrets.
SECRETS = "api_key|apikey|token|secret|password|authorization"


def redacted(text: Column) -> Column:
    """JSON text with the string values of secret fields masked, whatever the case of their names."""
    return F.regexp_replace(text, f'(?i)("(?:{SECRETS})"\\s*:\\s*)"(?:[^"\\\\]|\\\\.)*"', '$1"***"')
