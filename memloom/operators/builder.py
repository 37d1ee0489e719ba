"""Checking what a builder wrote: JSON out of its text, items with a statement and sources, and why others are refused.

All of it is SQL over variants, so that it runs in the JVM; an output is a bounded text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items of an output at most.
MAX_ITEMS = 6


def fenced(raw: Column) -> Column:
    """The text inside the first complete fence of an output, else all of it, without white space around."""
    text = F.regexp_replace(raw, "^\\s+|\\s+$", "")
    inside = F.regexp_extract(text, "(?is)(?:^|\\n)[ \\t]*```(?:json)?[ \\t]*\\n(.*?)(?:^|\\n)[ \\t]*```[ \\t]*(?:\\n|$)", 1)
    return F.regexp_replace(F.when(inside != "", inside).otherwise(text), "^\\s+|\\s+$", "")


def balanced(text: str, opener: str, closer: str) -> str:
    """SQL: from the first ``opener`` in ``text`` to the bracket that closes it, strings skipped; null if there is none."""
    step = f"""CASE WHEN s.stop > 0 THEN s
      WHEN s.quoted THEN named_struct('i', s.i + 1, 'depth', s.depth, 'quoted', s.escaped OR c <> '"', 'escaped', NOT s.escaped AND c = '\\\\', 'stop', 0)
      ELSE named_struct('i', s.i + 1, 'depth', s.depth + if(c = '{opener}', 1, 0) - if(c = '{closer}', 1, 0), 'quoted', c = '"', 'escaped', false, 'stop', if(c = '{closer}' AND s.depth = 1, s.i + 1, 0)) END"""
    rest = f"substring({text}, locate('{opener}', {text}))"
    stop = f"aggregate(split({rest}, ''), named_struct('i', 0, 'depth', 0, 'quoted', false, 'escaped', false, 'stop', 0), (s, c) -> {step}, s -> s.stop)"
    return f"CASE WHEN locate('{opener}', {text}) > 0 AND {stop} > 0 THEN substring({rest}, 1, {stop}) END"


def whole_json(text: Column) -> Column:
    """The JSON value (variant) that a text is; null if it is none, or has more behind one: the parser itself stops after the first value."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = F.size(F.try_variant_get(inside, "$", "array<variant>")) == 1
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(alone & member.isNotNull(), F.try_parse_json(F.nullif(text, F.lit(""))))


def parse(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``value`` (variant): the JSON of an output, of its whole text or else of its first balanced object, then array; null if none is valid."""
    plain = outputs.withColumn("_text", fenced(F.coalesce(raw, F.lit(""))))
    plain = plain.withColumn("value", whole_json(F.col("_text")))
    for opener, closer in (("{", "}"), ("[", "]")):
        found = F.try_parse_json(F.when(F.col("value").isNull(), F.expr(balanced("_text", opener, closer))))
        plain = plain.withColumn("value", F.coalesce("value", found))
    return plain.drop("_text")


# The only member of a teacher's reply, how a reply begins whose last brace alone is missing, and the note of its repair.
ROOT, BEGIN, REPAIRED = "requirements", '{"requirements":', "appended_missing_root_object_closer"


def teacher_reply(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``reply`` (variant, an object), ``repair`` and ``error`` to a teacher's outputs.

    A complete list of requirements that lacks the closing brace of the root object, and nothing else, gets it; any other broken text is ``parse_error``, and
    JSON that is no object ``root_not_object``. Nothing inside a reply is ever added or changed.
    """
    rows = outputs.withColumn("_text", fenced(F.coalesce(raw, F.lit(""))))
    rows = rows.withColumn("_whole", whole_json(F.col("_text")))
    may = F.col("_whole").isNull() & F.startswith("_text", F.lit(BEGIN)) & F.endswith("_text", F.lit("]"))
    closed = F.when(may, whole_json(F.concat("_text", F.lit("}"))))
    rows = rows.withColumn("_closed", closed)
    alone = F.expr(f"map_keys(try_variant_get(_closed, '$', 'map<string,variant>')) = array('{ROOT}')")
    rows = rows.withColumn("_closed", F.when(alone, F.col("_closed")))
    found = F.coalesce("_whole", "_closed")
    kind = F.schema_of_variant(found)
    error = F.when(found.isNull(), "parse_error").when(~F.startswith(kind, F.lit("OBJECT<")), "root_not_object")
    return rows.withColumns({"reply": F.when(error.isNull(), found), "repair": F.when(F.col("_closed").isNotNull(), F.lit(REPAIRED)), "error": error}).drop("_text", "_whole", "_closed")


def checked_items(outputs: DataFrame, allowed: str = "allowed") -> DataFrame:
    """Adds ``items`` (array of place, m, src, reason) and ``error`` (of the whole output) to outputs with ``value``.

    ``allowed``: array of the ids that the builder was given. reason is null for a good item. An output that is no array, or
    has over MAX_ITEMS items, has no items.
    """
    kind = "schema_of_variant({v})"
    array = f"{kind.format(v='value')} LIKE 'ARRAY<%'"
    error = F.expr(f"CASE WHEN value IS NULL THEN 'parse_error' WHEN NOT {array} THEN 'root_not_array' WHEN size(try_variant_get(value, '$', 'array<variant>')) > {MAX_ITEMS} THEN 'too_many_memories' END")
    src = "try_variant_get(x, '$.src', 'array<variant>')"
    ids = f"transform({src}, v -> try_variant_get(v, '$', 'bigint'))"
    fields = "array_sort(map_keys(try_variant_get(x, '$', 'map<string,variant>')))"
    message = "CASE WHEN schema_of_variant(try_variant_get(x, '$.m', 'variant')) = 'STRING' THEN regexp_replace(try_variant_get(x, '$.m', 'string'), '^\\\\s+|\\\\s+$', '') END"
    reason = f"""CASE WHEN coalesce({fields} <> array('m', 'src'), true) THEN 'invalid_fields'
      WHEN coalesce({message}, '') = '' THEN 'empty_memory'
      WHEN coalesce(size({src}), 0) < 1 OR exists({src}, v -> coalesce(schema_of_variant(v), '') <> 'BIGINT') THEN 'invalid_src'
      WHEN size(array_distinct({ids})) < size({ids}) OR size(array_except({ids}, {allowed})) > 0 THEN 'src_out_of_input' END"""
    items = f"transform(try_variant_get(value, '$', 'array<variant>'), (x, i) -> named_struct('place', i, 'm', {message}, 'src', {ids}, 'reason', {reason}))"
    return outputs.withColumn("error", error).withColumn("items", F.expr(f"CASE WHEN error IS NULL THEN {items} END"))


# What a builder is told, and the shape of its output.
SYSTEM = (
    "Extract only source-supported task memory. Preserve dates, negation and exceptions. "
    "Return only a valid JSON array, with no explanation or markdown. Each item must be "
    "an object with exactly the keys m (string) and src (integer array)."
)
#: Control characters that Spark escapes with capital letters.
_CAPITALS = [f"{i:04X}" for i in (*range(0x0B, 0x10), *range(0x1A, 0x20)) if i not in (0x0C, 0x0D)]


def source_row(s: Column) -> Column:
    """A source as the builder's input has it: its fields sorted."""
    fields = ["id", "position", "session", "source_id", "source_offset", "speaker", "text", "time"]
    value = {"text": lambda s: F.coalesce(s["text"], F.lit("")), "source_id": lambda s: F.coalesce(s["source_id"].cast("string"), s["id"].cast("string"))}
    return F.struct(*(value.get(x, lambda s, x=x: s[x])(s).alias(x) for x in fields))


def canonical_json(value: Column) -> Column:
    """A struct as JSON text: nulls kept, no spaces, escapes in small letters."""
    text = F.to_json(value, {"ignoreNullFields": "false"})

    def lowered(text: Column) -> Column:
        out = text
        for code in _CAPITALS:  # behind an even number of backslashes only: a backslash of the text itself is doubled
            out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}")
        return F.when(F.contains(text, F.lit("\\u")), out).otherwise(text)  # most texts have no such character

    return F.get(F.transform(F.array(text), lowered), 0)


def input_json(sources: str, structure: str, architecture: Column, contract: Column, schema: str) -> Column:
    """The builder's input as canonical JSON: keys sorted, no spaces, nulls kept, no question.

    ``sources``: array of structs (id, source_id, session, speaker, time, position, source_offset, text), written in the order of
    their ids; ``structure``: a struct with sorted fields. Equal inputs give equal text, whose SHA-256 names them.
    """
    output = F.struct(F.struct(F.lit("string").alias("m"), F.lit("integer[]").alias("src")).alias("item"), F.lit(MAX_ITEMS).alias("max_items"), F.lit("array").alias("type"))
    envelope = F.struct(
        architecture.alias("architecture"), contract.alias("architecture_contract"), output.alias("output"), F.lit(schema).alias("schema"),
        F.transform(F.array_sort(sources, lambda a, b: F.sign(a["id"] - b["id"]).cast("int")), source_row).alias("sources"), F.col(structure).alias("structure"),
        F.lit(SYSTEM).alias("system"), F.lit(True).alias("write_stage"),
    )
    return canonical_json(envelope)


def future_queries(rows: DataFrame) -> Column:
    """The queries that a row is judged by: ``future_queries``, else ``queries``, else the one of a row with an answer; those without a question are left out.

    Both lists are arrays of structs (question, answer, category).
    """
    own = F.array(F.struct(F.coalesce("question", F.lit("")).alias("question"), F.col("answer").alias("answer"), F.coalesce("category", F.lit(1)).alias("category")))
    kind = rows.schema["future_queries"].dataType
    found = F.coalesce("future_queries", "queries", F.when(F.col("answer").isNotNull(), own.cast(kind)), F.array().cast(kind))
    return F.filter(found, lambda q: q["question"].isNotNull())
