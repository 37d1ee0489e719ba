"""Write blocks of a memory: applied once each, entries that contradict each other marked, the later one read.

A block is what one write brings: statements that an architecture built from some sources under a configuration. Its
identity is a digest of these three, so that a block that was written before changes nothing. All of it is decided by the times of writing, not by the
order of arrival: replayed and reordered blocks leave the same memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.state import entries_after


def block_digest(architecture: Column, source_ids: Column, config: Column) -> Column:
    """Identity of a block: SHA-256 of its architecture, its distinct sources in order and its configuration."""
    return F.sha2(F.to_json(F.struct(architecture.alias("architecture"), F.array_sort(F.array_distinct(source_ids)).alias("sources"), config.alias("config")), {"ignoreNullFields": "false"}), 256)


def first_writes(items: DataFrame) -> DataFrame:
    """The items of the first write of each block, each once.

    ``items``: memory, block (identity), written (time), item (number in its write) and others. A block that is written again at a later
    time is left out as a whole, and so are repeated rows. A block that is replayed very often is reduced before it is shuffled.
    """
    first = items.groupBy("memory", "block").agg(F.min("written").alias("written"))
    kept = items.join(first, ["memory", "block", "written"])
    others = [c for c in items.columns if c not in ("memory", "block", "written", "item")]
    once = kept.groupBy("memory", "block", "written", "item").agg(F.any_value(F.struct(*others)).alias("row"))
    return once.select("memory", "block", "written", "item", "row.*")


def replays(items: DataFrame) -> DataFrame:
    """``memory, block, writes, replayed``: the times at which a block was written, and how many of these came too late to count."""
    times = items.groupBy("memory", "block").agg(F.count_distinct("written").alias("writes"))
    return times.withColumn("replayed", F.col("writes") - 1)


def updated_entries(items: DataFrame) -> DataFrame:
    """Entries after all blocks: ``memory, entry, m, src, version, entity, moment, written``; version is the block's identity.

    ``items`` as for :func:`first_writes`, with m (statement), src (ids of its sources), entity and moment (what and when it speaks of; either may be null).
    An entry of the same sources replaces the earlier one in place; others are kept side by side.
    """
    placed = first_writes(items).withColumns({"place": F.struct("written", "block", "item"), "version": F.col("block")})
    return entries_after(placed, "entity", "moment", "written")


def with_conflicts(entries: DataFrame) -> DataFrame:
    """Adds ``conflict`` and ``current`` to entries: whether another entry of the memory says something else of the same entity and moment,
    and whether this is the one to read: the last written of those, of equal times the last entry.

    Entries without entity or moment contradict nothing. One aggregate and one join, so many entries of one entity are no window.
    """
    subject = ["memory", "entity", "moment"]
    sides = entries.where("entity IS NOT NULL AND moment IS NOT NULL").groupBy(*subject).agg(F.min("m").alias("_low"), F.max("m").alias("_high"), F.max(F.struct("written", "entry")).alias("_last"))
    both = entries.join(sides.where("_low <> _high"), subject, "left")
    conflict = F.col("_last").isNotNull()
    return both.withColumns({"conflict": conflict, "current": ~conflict | (F.struct("written", "entry") == F.col("_last"))}).drop("_low", "_high", "_last")


def readable(flagged: DataFrame) -> DataFrame:
    """What a read sees: of entries in conflict the late one only."""
    return flagged.where("current").drop("conflict", "current")
