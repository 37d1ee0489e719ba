"""Comparing the members of buckets pair by pair without emitting the pairs.

A bucket is cut into blocks by a hash of its members, so many that a block has a bounded number of
members; every pair of blocks is one unit of work, in which vectorised code compares the members
and returns rows per member. Rows grow with the members times the blocks of their bucket, never
with the pairs, and a bucket of any size spreads over many tasks.

Members meet in several buckets. A pair is taken in the first bucket that both share, so that
its links count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.components import unsent

UNIT = ["group", "block_a", "block_b"]
#: Members up to which a unit is compared together with others.
SMALL = 64
#: Pairs that are compared at once.
PAIRS = 1 << 15


def bucket_blocks(members: DataFrame, most: int, weight: str | None = None, heaviest: int = 1) -> DataFrame:
    """``members`` (group, id and others) with ``block`` and ``n_blocks``. Buckets of one member are left out.

    A block has about ``most`` members at most and, where ``weight`` names a column, about ``heaviest`` weight, or is a single heavier member.
    """
    heavy = F.sum(weight) / F.lit(heaviest) if weight else F.lit(0)
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.ceil(heavy).alias("_w")).where("n > 1")
    sizes = sizes.select("group", F.least(F.col("n"), F.greatest(F.ceil(F.col("n") / F.lit(most)), F.col("_w"))).cast("int").alias("n_blocks"))
    return members.join(unsent(sizes), "group").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))


def block_pairs(placed: DataFrame) -> DataFrame:
    """A row for each pair of blocks that a member takes part in. Adds ``block_a <= block_b``."""
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    pairs = placed.withColumn("_other", other)
    return pairs.withColumns({"block_a": F.least("block", "_other"), "block_b": F.greatest("block", "_other")}).drop("_other", "n_blocks")


def dealt(units: DataFrame) -> DataFrame:
    """The rows of each unit in one task, one unit after the other."""
    return units.repartition(*UNIT).sortWithinPartitions(*UNIT)


def _last_start(batch: pa.RecordBatch) -> int:
    """Where the last unit of a batch begins."""
    at = 0
    for name in UNIT:
        column = batch.column(name).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(column[1:] != column[:-1])
        at = max(at, int(change[-1]) + 1 if len(change) else 0)
    return at


def whole_units(batches: Iterable[pa.RecordBatch], least_rows: int = 20_000, least_bytes: int = 4 << 20) -> Iterator[pa.Table]:
    """Tables of complete units, many small ones together; batches are sorted by UNIT."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, i: tuple(batch.column(x)[i].as_py() for x in UNIT)
    for batch in batches:
        if not batch.num_rows:
            continue
        at = _last_start(batch)
        border = at > 0 or not held or key(held[-1], held[-1].num_rows - 1) != key(batch, 0)
        before = [*held, batch.slice(0, at)] if at else held
        if border and before and (sum(x.num_rows for x in before) >= least_rows or sum(x.nbytes for x in before) >= least_bytes):
            yield pa.Table.from_batches(before).combine_chunks()
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_of_units(units: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of the members that meet in each unit of ``units``, which holds whole units; a bounded number at once.

    In a unit of two blocks, one member is of each; in a unit of a block with itself i < j.
    """
    group, a, b, block = (units[x].to_numpy() for x in (*UNIT, "block"))
    n = len(group)
    change = np.flatnonzero((group[1:] != group[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [n]])
    sizes = ends - starts
    end_of = np.repeat(ends, sizes)
    at = np.arange(n)[np.repeat(sizes <= SMALL, sizes)]
    for step in range(1, SMALL):
        at = at[at + step < end_of[at]]
        if not len(at):
            break
        use = at[(a[at] == b[at]) | (block[at] != block[at + step])]
        for k in range(0, len(use), PAIRS):
            yield use[k : k + PAIRS], use[k : k + PAIRS] + step
    for start, end in zip(starts[sizes > SMALL], ends[sizes > SMALL], strict=True):
        here, same = np.arange(start, end), a[start] == b[start]
        left = here[block[start:end] == a[start]]
        right = here[block[start:end] == b[start]]
        rows = max(1, PAIRS // max(1, len(right)))
        for k in range(0, len(left), rows):
            i, j = np.repeat(left[k : k + rows], len(right)), np.tile(right, len(left[k : k + rows]))
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j


def smallest_linked(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n members, the smallest id that the links i - j reach."""
    best = ids.copy()
    while True:
        low = np.minimum(best[i], best[j])
        new = best.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == best).all():
            return best
        best = new


def member_rows(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """A row for each linked member: id, links (copies of its partners), smallest id it reaches here."""
    links = np.bincount(i, copies[j], minlength=len(ids)) + np.bincount(j, copies[i], minlength=len(ids))
    at = np.flatnonzero(links)
    roots = smallest_linked(len(ids), i, j, ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(roots[at])], names=["id", "links", "root"])


MEMBER_ROWS = "id long, links long, root long"
