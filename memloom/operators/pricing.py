"""Exact cost of what a builder reads: the tokens of its whole input, for each set of sources and architecture.

Such a cost is not the sum of its parts: instruction, envelope and structure count too, and tokens don't add up. So every distinct set
is written out and counted once; what was counted before is looked up. Rows are one per set, and the text of an input lives
in the task that counts it. Where a tokenizer splits words from signs, though, parts that end so do add up: then each source is
counted once, and each shape of an input (architecture and ids) once for all units.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators import builder
from memloom.operators.domain import FULL, MOST, ids_of
from memloom.sources.scratch import materialize

KEYS = ["unit", "architecture"]
#: Texts that a tokenizer is given at once: their tokens take far more memory than they.
AT_ONCE = 256

# The instruction before the input of a builder.
INSTRUCTION = (
    "Build a {architecture} structured memory from the supplied sources only; do not use a query or future query. Return ONLY the JSON array: no explanation, "
    "no Markdown, and no code fence. Each element must be an object with exactly "
    'two keys, "m" and "src". "m" is a short sentence written from the sources; '
    '"src" is the integer array of source ids supporting it. Replace the '
    "placeholders below with real extracted content: "
    '[{"m":"<sentence taken from the sources>","src":[...source ids...]}].'
)
#: Contracts that the input names by architecture.
CONTRACTS = {"Flat": "no order", "Chain": "one path"}


def structure_of(architecture: Column, ids: Column) -> Column:
    """The structure over sorted ids: no edges for Flat, neighbours joined for Chain."""
    edges = F.transform(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), lambda x, i: F.array(x, F.get(ids, i + 1)))
    none = F.array().cast("array<array<int>>")
    return F.struct(architecture.alias("architecture"), F.when(architecture == "Chain", edges).otherwise(none).alias("edges"), F.when(architecture == "Flat", F.array(ids)).otherwise(none).alias("groups"), ids.alias("nodes"))


def prompts(sets: DataFrame, sources: DataFrame) -> DataFrame:
    """``unit, architecture, mask, prompt``: what the builder reads for each set.

    ``sources``: unit, n and ``sources``, the structs that ``builder.input_json`` writes, ids from 1; a unit has at most 64.
    """
    rows = sets.join(sources, "unit").withColumn("_ids", ids_of("mask")).withColumn("_structure", structure_of(F.col("architecture"), F.col("_ids")))
    rows = rows.withColumn("_taken", F.expr("filter(sources, s -> (shiftright(mask, int(s.id - 1)) & 1) = 1)"))
    contract = F.coalesce(*(F.when(F.col("architecture") == k, F.lit(v)) for k, v in CONTRACTS.items()))
    before, after = INSTRUCTION.split("{architecture}")
    text = F.concat(F.lit(before), "architecture", F.lit(after + "\n"), builder.input_json("_taken", "_structure", F.col("architecture"), contract, "memory-1"))
    return rows.select("unit", "architecture", "mask", text.alias("prompt"))


def adds_up(definition: str) -> bool:
    """Whether a tokenizer, given as the JSON text of its definition, never joins a quote with the letter behind it, nor a letter with the brace behind it, into a token.

    True for byte-level ones that split words, numbers and signs, without normalizer; an added token must not hold such a pair or take in what stands around it.
    """
    spec = json.loads(definition)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
    return bool(plain and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or '"i' in x["content"] or "l}" in x["content"] for x in added))


def in_parts(asked: DataFrame, sources: DataFrame, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``unit, architecture, mask, cost``: what ``count(prompts(asked, sources))`` gives, for a tokenizer whose counts add up (:func:`adds_up`); no set is empty.

    A source begins ``{"id`` and ends ``null}``: inside it all is tokenised by itself. So an input costs what one of the same shape does whose sources are stand-ins, and
    for each source what it costs more than its stand-in. Units whose ids aren't 1 to n, or with a source that ends otherwise (a time), are written out whole.
    """
    regular = "transform(array_sort(transform(sources, s -> s.id)), i -> bigint(i)) = sequence(1L, bigint(n)) AND forall(sources, s -> s.time IS NULL)"
    sources = sources.withColumn("_regular", F.coalesce(F.expr(f"n > 0 AND {regular}"), F.lit(False)))
    unit, kind = asked.schema["unit"].dataType, sources.schema["sources"].dataType
    fields = ", ".join(f"'{x.name}', CAST({'i' if x.name == 'id' else 'NULL'} AS {x.dataType.simpleString()})" for x in kind.elementType)
    standins = asked.sparkSession.range(1).select(F.lit(0).cast(unit).alias("unit"), F.lit(MOST).cast("long").alias("n"), F.expr(f"transform(sequence(1, {MOST}), i -> named_struct({fields}))").alias("sources"))
    shapes = asked.join(sources.where("_regular").select("unit"), "unit", "left_semi").select("architecture", "mask").distinct()
    shapes = count(prompts(shapes.withColumn("unit", F.lit(0).cast(unit)), standins)).select("architecture", "mask", F.col("cost").alias("_shape"))

    def each(units: DataFrame) -> DataFrame:
        source = units.select("unit", F.explode("sources").alias("s"))
        own = source.select("unit", F.lit("").alias("architecture"), F.expr("shiftleft(1L, int(s.id - 1))").alias("mask"), builder.canonical_json(builder.source_row(F.col("s"))).alias("prompt"))
        return count(own).select("unit", F.col("mask").alias("_bit"), F.col("cost").alias("_cost"))

    more = each(sources.where("_regular")).join(F.broadcast(each(standins).select("_bit", F.col("_cost").alias("_standin"))), "_bit")
    more = more.groupBy("unit").agg(F.collect_list(F.struct(F.col("_bit").alias("bit"), (F.col("_cost") - F.col("_standin")).alias("more"))).alias("_parts"))
    parts = asked.join(more, "unit").join(shapes, ["architecture", "mask"])
    cost = F.expr("aggregate(_parts, _shape, (c, p) -> c + if((mask & p.bit) <> 0, p.more, 0L))")
    whole = count(prompts(asked, sources.where("NOT _regular").drop("_regular")))
    return parts.select(*KEYS, "mask", cost.alias("cost")).unionByName(whole)


def by_bytes(priced: DataFrame) -> DataFrame:
    """Counts a token for every four bytes that are begun."""
    return priced.select("unit", "architecture", "mask", F.ceil(F.octet_length("prompt") / F.lit(4)).cast("long").alias("cost"))


def by_tokenizer(definition: str) -> Callable[[DataFrame], DataFrame]:
    """Counts the ids of a tokenizer, given as the JSON text of its definition; a table of vocabulary size, sent once to each executor."""

    def count(priced: DataFrame) -> DataFrame:
        shared = priced.sparkSession.sparkContext.broadcast(definition)

        def run(batches):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(shared.value)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            for batch in batches:
                costs = []
                for at in range(0, batch.num_rows, AT_ONCE):
                    costs += [len(x.ids) for x in tokenizer.encode_batch(batch.column("prompt").slice(at, AT_ONCE).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in (*KEYS, "mask")), pa.array(costs, pa.int64())], names=[*KEYS, "mask", "cost"])

        return priced.mapInArrow(run, f"unit {priced.schema['unit'].dataType.simpleString()}, architecture string, mask long, cost long")

    return count


def price(sets: DataFrame, sources: DataFrame, count: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, parts: bool = False) -> DataFrame:
    """``unit, architecture, mask, cost`` of all sets and of ``known`` ones, each once; only sets that aren't known are counted. The empty set costs 0.

    A stored table: pass it as ``known`` to the next call. ``parts``: ``count`` is a tokenizer's and adds up, see :func:`in_parts`.
    """
    asked = sets.select(*KEYS, "mask").distinct()
    if known is not None:
        asked = asked.join(known, [*KEYS, "mask"], "left_anti")
    filled = asked.where("mask <> 0")
    counted = (in_parts(filled, sources, count) if parts else count(prompts(filled, sources))).unionByName(asked.where("mask = 0").withColumn("cost", F.lit(0).cast("long")))
    new = materialize(counted, "costs")
    return new if known is None else known.unionByName(new)


def prefix_masks(sets: DataFrame) -> DataFrame:
    """``unit, architecture, mask, prefix``: each set with every prefix of its sorted ids, itself included, the empty set as its own."""
    ids = F.explode_outer(ids_of("mask")).alias("_id")
    upto = F.expr("CASE WHEN _id IS NULL THEN 0L WHEN _id = 64 THEN mask ELSE mask & ~shiftleft(-1L, _id) END")
    return sets.select(*KEYS, "n", "mask", ids).select(*KEYS, "mask", upto.alias("prefix"))


def with_costs(sets: DataFrame, sources: DataFrame, count: Callable[[DataFrame], DataFrame], known: DataFrame | None = None, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Sets with ``cost`` and ``reach`` (the dearest of their prefixes), and the table of all costs that were counted.

    A budget reaches a set if it is at least its reach: with exact costs a prefix may cost more than the set.
    """
    sets = materialize(sets, "sets")
    steps = prefix_masks(sets)
    priced = price(steps.select(*KEYS, F.col("prefix").alias("mask")), sources, count, known, parts)
    reach = steps.join(priced.withColumnRenamed("mask", "prefix"), [*KEYS, "prefix"]).groupBy(*KEYS, "mask").agg(F.max("cost").alias("reach"))
    return sets.join(priced, [*KEYS, "mask"]).join(reach, [*KEYS, "mask"]), priced


def capped(priced: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The sets of a domain: those that cost at most the full set, of units whose full set costs at most ``limit``."""
    full = priced.where(f"mask = {FULL}").select(*keys, F.col("cost").alias("_full"))
    return priced.join(full, list(keys)).where((F.col("_full") <= limit) & (F.col("cost") <= F.col("_full"))).drop("_full")
