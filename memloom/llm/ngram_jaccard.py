"""Near-duplicate documents by the Jaccard similarity of their word n-grams.

1. Texts with equal words are one class; only a representative text of each class goes on.
2. MinHash bands propose candidates: only classes that share a band are compared, in the bucket of
   that band, which is cut into blocks. Signatures alone are shipped for that.
3. MinHash values are compared 32 at a time. A pair is dropped when the posterior probability that
   its similarity reaches the threshold (uniform prior, m of n values equal) falls below
   ``TOLERANCE``. Only classes with a pair that is left go on, and only with the buckets of such pairs.
4. Their n-gram sets are fetched, and the pairs that are left are verified exactly on them.
5. Links give each document its number of links and its component.

A pair that shares several bands is taken in the first of them. A pair at the very threshold shares
no band with probability 3e-6, a more similar one with less.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.arrow_text import WordValues, ragged_take, row_blocks, text_bytes, tidy
from memloom.llm.blocks import MEMBER_ROWS, UNIT, block_pairs, bucket_blocks, dealt, member_rows, pairs_of_units, whole_units
from memloom.llm.columns import set_aside
from memloom.llm.components import components, unsent
from memloom.sources.scratch import drop, materialize

N, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 32, 5, 32
#: Members of a block of a bucket.
BLOCK = 1024
#: N-grams of a block's members together (16 MB): long texts make smaller blocks, so that a unit of two blocks fits in any task.
HEAVIEST = 1 << 21
#: Grams of sets that are compared exactly at once.
GRAMS = 1 << 19
#: Rows of a text: its id, and two hashes of it.
ROW_KEY = ["id", "h1", "h2"]

_RANDOM = np.random.default_rng(20240229)
_SEEDS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_FACTORS = (_RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]

_WORDS = WordValues(xxhash.xxh3_64_intdigest)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def grams_of(values: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's word hashes. A text of fewer words is one gram."""
    n = min(n, len(values))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[i : len(values) - n + 1 + i]
    return np.unique(_mix(out))


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values of a set of grams that is not empty: the low 16 bits of the least hashes."""
    short = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, short.shape[1], 1024):
        best = np.minimum(best, ((short[:, at : at + 1024] ^ _SEEDS) * _FACTORS).min(axis=1))
    return best.astype(np.uint16)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For n = 32, 64, ... values compared: the fewest equal ones with which a pair goes on.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1), and the
    probability that it reaches t is that of at most m successes in n + 1 trials of chance t.
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def _texts(column: pa.Array):
    """For each text in order: its word hashes."""
    data, offsets = text_bytes(column)
    for row, end in row_blocks(offsets):
        values, rows = _WORDS.of(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], np.uint64)
        at = np.searchsorted(rows, np.arange(end - row + 1))
        yield row, end, [values[at[i] : at[i + 1]] for i in range(end - row)]


def sketch(docs: DataFrame) -> DataFrame:
    """``id, h1, h2, text`` -> ``id, h1, h2, class`` (128-bit hash of the words; null without words), ``mark`` (the signature)."""

    def run(batches):
        for batch in batches:
            for row, end, texts in _texts(batch.column(3)):
                classes = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in texts]
                grams = [grams_of(x) if len(x) else x for x in texts]
                marks, sizes = [signature(x).tobytes() if len(x) else None for x in grams], [len(x) for x in grams]
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns[:3]), pa.array(classes, pa.binary()), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64())], names=[*ROW_KEY, "class", "mark", "size"])

    return docs.select(*ROW_KEY, "text").mapInArrow(tidy(run), "id long, h1 long, h2 long, class binary, mark binary, size long")


def _with_sets(texts: DataFrame) -> DataFrame:
    """``id, copies, text`` -> ``id, copies, grams`` (the sorted n-gram set), ``mark``, both binary."""

    def run(batches):
        for batch in batches:
            for row, end, values in _texts(batch.column(2)):
                sets = [grams_of(x) for x in values]
                marks = [signature(x).tobytes() if len(x) else b"" for x in sets]
                yield pa.RecordBatch.from_arrays([*(c.slice(row, end - row) for c in batch.columns[:2]), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array(marks, pa.binary())], names=["id", "copies", "grams", "mark"])

    return texts.select("id", "copies", "text").mapInArrow(tidy(run), "id long, copies long, grams binary, mark binary")


def likely_pairs(marks: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that ``band`` is the first shared band of and that may still reach the threshold, comparing STEP values at a time."""
    matches = np.zeros(len(i), np.int32)
    for n in range(0, BANDS * ROWS, STEP):
        matches = matches + (marks[i, n : n + STEP] == marks[j, n : n + STEP]).sum(axis=1)
        use = matches >= least[n + STEP]
        matches, i, j = matches[use], i[use], j[use]
    shared = (marks[i].reshape(-1, BANDS, ROWS) == marks[j].reshape(-1, BANDS, ROWS)).all(axis=2)
    use = shared.any(axis=1) & (shared.argmax(axis=1) == band[i]) & (band[i] == band[j])
    return i[use], j[use]


def exact_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sets reach the threshold; the sets that are worked on at once hold ``GRAMS`` grams, or are those of one pair."""
    if not len(i):
        return i, j
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    if len(i) > 1 and sum(len(sets[x]) for x in used) > GRAMS:
        order = np.lexsort((j, i))
        halves = [exact_pairs(sets, i[x], j[x], threshold) for x in np.array_split(order, 2)]
        return np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves])
    # numbers instead of hashes, then one look-up table for each i
    sets, own, other = [sets[x] for x in used], back[: len(i)], back[len(i) :]
    sizes = np.array([len(x) for x in sets], np.int64)
    names, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(own, kind="stable")
    own, other = own[order], other[order]
    mark, good = np.zeros(len(names), bool), np.zeros(len(own), bool)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = numbers[starts[own[a]] : starts[own[a]] + sizes[own[a]]]
        mark[mine] = True
        partners = other[a:b]
        hits = mark[ragged_take(numbers, starts[partners], sizes[partners])]
        shared = np.add.reduceat(hits.astype(np.int64), np.cumsum(sizes[partners]) - sizes[partners])
        good[a:b] = shared >= threshold * (sizes[own[a]] + sizes[partners] - shared) - 1e-9
        mark[mine] = False
    return i[order[good]], j[order[good]]


def _marks(units: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(units["mark"].to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)


def _meetings(least: dict[int, int]):
    """The members of each unit that are in a likely pair of it."""

    def run(batches):
        for units in whole_units(batches):
            marks, band, hit = _marks(units), units["band"].to_numpy(), np.zeros(units.num_rows, bool)
            for i, j in pairs_of_units(units):
                i, j = likely_pairs(marks, band, i, j, least)
                hit[i] = hit[j] = True
            yield from units.select([*UNIT, "block", "band", "id"]).filter(pa.array(hit)).to_batches()

    return run


def _verified(least: dict[int, int], threshold: float):
    def run(batches):
        for units in whole_units(batches):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in units["grams"]]
            marks, band = _marks(units), units["band"].to_numpy()
            for_each = [exact_pairs(sets, *likely_pairs(marks, band, i, j, least), threshold) for i, j in pairs_of_units(units)]
            i, j = (np.concatenate([x[k] for x in for_each]) if for_each else np.zeros(0, int) for k in (0, 1))
            yield member_rows(units["id"].to_numpy(), units["copies"].to_numpy(), i, j)

    return run


def linked(compared: DataFrame, classes: DataFrame) -> DataFrame:
    """What the comparisons found about each class: ``node, links, component`` (of nodes), ``component_id`` (smallest ``rep`` in it).

    ``compared``: id (a node), links, root. ``classes``: node, rep.
    """
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    nodes = unsent(links).join(unsent(found), "id").withColumnRenamed("id", "node")
    smallest = unsent(nodes).join(unsent(classes.select("node", "rep")), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    return unsent(nodes).join(unsent(smallest), "component")


def _linked_rows(source: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``id, h1, h2, rep, n_links, component, component_id`` of every row of ``source`` (ROW_KEY, text).

    component is a number of the group of linked classes, null for a row without words or id.
    """
    least = least_matches(threshold, tolerance)
    sketches = materialize(sketch(source), "sketches")
    worded = sketches.where("id IS NOT NULL AND class IS NOT NULL")
    classes = worded.groupBy("class").agg(F.min(F.struct(*ROW_KEY)).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("mark").alias("mark"), F.any_value("size").alias("size"))
    # a number of its own for each class: ids may repeat
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "class", "first", F.col("first.id").alias("rep"), "copies", "mark", "size"), "classes")

    band = lambda k: F.struct(F.lit(k).alias("band"), F.xxhash64(F.lit(k), F.expr(f"substring(mark, {2 * ROWS * k + 1}, {2 * ROWS})")).alias("group"))
    buckets = classes.select(F.col("node").alias("id"), "size", F.explode(F.array(*map(band, range(BANDS)))).alias("at")).select("id", "size", "at.*")
    placed = bucket_blocks(buckets, BLOCK, "size", HEAVIEST).drop("size").join(classes.select(F.col("node").alias("id"), "mark"), "id")
    kind = "group long, block_a int, block_b int, block int, band int, id long"
    met = materialize(dealt(block_pairs(placed)).select(*UNIT, "block", "band", "id", "mark").mapInArrow(tidy(_meetings(least)), kind), "met")

    wanted = classes.join(met.select(F.col("id").alias("node")).distinct(), "node").select(F.col("node"), "copies", "first.*")
    # rows that repeat id and text: one of them will do
    texts = source.join(wanted.hint("shuffle_hash"), ROW_KEY).groupBy(*ROW_KEY, "node", "copies").agg(F.any_value("text").alias("text"))
    sets = _with_sets(texts.select(F.col("node").alias("id"), "copies", "text"))
    units = dealt(met.join(sets, "id")).select(*UNIT, "block", "band", "id", "copies", "grams", "mark")
    compared = materialize(units.mapInArrow(tidy(_verified(least, threshold)), MEMBER_ROWS), "compared")
    drop(met)

    found = classes.select("class", "node", "rep", "copies").join(linked(compared, classes).select("node", "links", "component", F.col("component_id").alias("smallest")), "node", "left")
    rows = sketches.select(*ROW_KEY, F.when(F.col("id").isNotNull(), F.col("class")).alias("class")).join(found, "class", "left")
    return rows.select(
        *ROW_KEY,
        F.coalesce("rep", "id").alias("rep"),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
        F.coalesce("smallest", "rep", "id").alias("component_id"),
    )


def _text_hashes(text: str) -> dict:
    return {"h1": F.xxhash64(text), "h2": F.xxhash64(F.lit(1), text)}


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Links of every document with all others whose word 5-grams have a Jaccard similarity of ``threshold`` or more.

    Returns one row per row of ``docs``: the id column, ``class_id`` (smallest id among texts with equal
    words), ``n_links`` (other rows linked directly, copies included), ``component_id`` (smallest id
    reachable by links, itself included) and ``kept`` (its id is that smallest one). Words are what
    stands between ASCII white space, as written. A text of fewer than five words has one gram:
    all its words. Texts without words and rows with a null id link with nothing and are kept.
    Rows that repeat an id, with the same text or another, are rows of their own: an id links nothing. An empty table gives no rows.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).withColumns(_text_hashes("text"))
    out = _linked_rows(source, threshold, tolerance)
    return out.select(F.col("id").alias(id_column), F.col("rep").alias("class_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of rows that links reach: the one with the smallest id.

    Of rows with that id, which may repeat, the one whose text has the smallest hash stays, once. All columns pass
    through, whatever their names. Rows without words or id stay.
    """
    clear, back = set_aside(docs, [*ROW_KEY], keep=())
    key, text = (clear.columns[docs.columns.index(x)] for x in (id_column, text_column))
    keyed = clear.withColumns({"id": F.col(key).cast("long"), **_text_hashes(F.col(text).cast("string"))})
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).withColumns(_text_hashes("text"))
    grouped = _linked_rows(source, threshold, tolerance).where("n_links > 0").groupBy("component", *ROW_KEY).agg(F.count(F.lit(1)).alias("n"))
    grouped = materialize(grouped, "grouped")
    stays = grouped.groupBy("component").agg(F.min(F.struct(*ROW_KEY)).alias("stays"))
    placed = grouped.join(stays, "component").withColumn("first", F.struct(*ROW_KEY) == F.col("stays"))
    decided = materialize(placed.where("NOT first OR n > 1").select(*ROW_KEY, "first"), "decided")
    alone = keyed.join(decided, ROW_KEY, "left_anti")
    repeated = keyed.join(decided.where("first").select(*ROW_KEY), ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    drop(grouped)
    return back(alone.unionByName(repeated))
