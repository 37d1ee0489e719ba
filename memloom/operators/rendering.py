"""Texts that a reader gets: sources, packets of evidence, and built memories. Column functions over bounded arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


# Fixed values in this module: headings, and the forms of a line.
def sources_text(blocks: Column, title: str = "Evidence") -> Column:
    """A heading and a numbered line for each block (source_id, dia_id, time, speaker, text): an unknown time is said, other nulls are empty."""
    empty = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    time = lambda b: F.coalesce(F.nullif(b["time"], F.lit("")), F.lit("unknown time"))
    line = lambda b, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] source_id="), empty(b["source_id"]), F.lit(" dia_id="), empty(b["dia_id"]), F.lit(" date="), time(b), F.lit(" speaker="), empty(b["speaker"]), F.lit(": "), empty(b["text"]))
    return _joined(F.concat(F.array(F.lit(f"{title}:")), F.transform(blocks, line)))


def packet_text(blocks: Column, hints: Column, prefix: Column | None = None) -> Column:
    """Evidence as a memory for one task: what it is, ``prefix`` if there is one, the sources, and hints on how they hang together. Null or empty hints and prefixes are none."""
    head = F.array(F.lit("Task-scoped memory packet."), F.lit("Use only this packet as supplied memory for the current task."))
    before = F.array() if prefix is None else F.when(F.length(prefix) > 0, F.array(F.regexp_replace(prefix, "^\\s+|\\s+$", ""))).otherwise(F.array())
    evidence = F.when(F.size(blocks) > 0, sources_text(blocks, "Original evidence")).otherwise("Original evidence: (empty)")
    related = F.when(F.length(hints) > 0, F.concat(F.lit("Relationship hints:\n"), hints)).otherwise("Relationship hints: (none)")
    return _joined(F.concat(head, before.cast("array<string>"), F.array(evidence, related)))


def build_text(memories: Column, architecture: Column, topology: Column) -> Column:
    """A built memory: architecture, topology (JSON text with sorted keys), and a line for each statement (m, src); empty without statements."""
    line = lambda m: F.concat(F.lit("- "), F.coalesce(m["m"], F.lit("")), F.lit(" [src:"), F.array_join(F.transform(F.coalesce(m["src"], F.array().cast("array<bigint>")), lambda x: x.cast("string")), ","), F.lit("]"))
    whole = _joined(F.concat(F.array(F.concat(F.lit("Architecture: "), architecture), F.concat(F.lit("Topology: "), F.coalesce(topology, F.lit("{}")))), F.transform(memories, line)))
    return F.when(F.size(memories) > 0, whole).otherwise("")
