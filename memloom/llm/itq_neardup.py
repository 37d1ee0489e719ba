"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

1. Equal vectors of a label are one class; only a representative goes on.
2. A rotation is learned (PCA, then iterative quantisation) on a bounded sample, so that the signs
   of the rotated vectors are balanced 64-bit codes.
   Vectors are moved by part of their mean only: the further they are moved, the more codes tell vectors apart that share a direction, but the
   more the codes of near ones differ. The largest part is taken with which neighbours planted at the very threshold beside vectors of the sample are still found.
3. Codes are cut into 8 chunks; each pair of chunks is a table, 28 in all, whatever the number of vectors (a caller may ask for
   each three of them, 56 in all, which finds other pairs). Only vectors that meet in a bucket of a table are compared, by their codes alone: two codes that differ in up
   to 6 bits (5 with keys of three chunks) meet for certain. Pairs that differ in at most ``RADIUS`` bits are retrieved, each in the first table in which it meets.
4. The original vectors of retrieved pairs are fetched to their buckets and the pairs are reranked in
   double precision: cosine at or over the threshold is a link.

Precision is exact; tests measure recall against brute force, on pairs just over the threshold too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.arrow_text import tidy
from memloom.llm.blocks import MEMBER_ROWS, UNIT, block_pairs, bucket_blocks, dealt, member_rows, pairs_of_units, whole_units
from memloom.llm.components import unsent
from memloom.llm.ngram_jaccard import linked
from memloom.sources.scratch import drop, materialize

THRESHOLD = 0.98
#: Rows that the rotation is learned on at most: those with the smallest hash of their id.
SAMPLE = 20_000
BITS, CHUNK, ROUNDS = 64, 8, 50
#: Bits in which retrieved pairs may differ.
RADIUS = 14
#: Members of a block of a bucket.
BLOCK = 1024

#: Share of planted neighbours that the tables must find.
LEAST_RECALL = 0.96
#: Sample rows that neighbours are planted beside at most, and parts of the mean that are tried, the largest first.
PLANTED, PARTS = 4000, np.linspace(1.0, 0.0, 11)


def tables_of(chunks: int) -> list[tuple[int, ...]]:
    """The chunks of the key of each table."""
    return list(combinations(range(BITS // CHUNK), chunks))


def table_bits(chunks: int) -> np.ndarray:
    """The bits of a code that make the key of each table."""
    return np.array([sum(0xFF << (CHUNK * x) for x in key) for key in tables_of(chunks)], np.uint64)


def quantisation(sample: np.ndarray, origin: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Projection (dimensions x 64) of iterative quantisation on unit vectors seen from ``origin``.

    Vectors of fewer than 64 dimensions get random directions for the bits that are left.
    """
    random = np.random.default_rng(seed)
    moved = sample - origin
    n = min(BITS, sample.shape[1])
    _, axes = np.linalg.eigh(moved.T @ moved)
    axes = axes[:, ::-1][:, :n]
    low = moved @ axes
    rotation = np.linalg.qr(random.standard_normal((n, n)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(low.T @ np.where(low @ rotation >= 0, 1.0, -1.0))
        rotation = u @ vt
    spare = random.standard_normal((sample.shape[1], BITS - n))
    return np.concatenate([axes @ rotation, spare], axis=1)


def neighbours(unit: np.ndarray, threshold: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose cosine with those of ``unit`` is the threshold: in random directions, and in the directions of other vectors of ``unit``."""
    random = np.random.default_rng(seed)
    out = []
    for towards in (random.standard_normal(unit.shape), unit[random.permutation(len(unit))] + 1e-9 * random.standard_normal(unit.shape)):
        apart = towards - np.einsum("ij,ij->i", towards, unit)[:, None] * unit
        apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-300)
        out.append(threshold * unit + np.sqrt(1 - threshold * threshold) * apart)
    return out[0], out[1]


def recall_of(unit: np.ndarray, near: np.ndarray, origin: np.ndarray, projection: np.ndarray, keys: np.ndarray) -> float:
    """Share of pairs (row of ``unit``, row of ``near``) that the tables retrieve."""
    apart = (codes_of(unit, origin, projection) ^ codes_of(near, origin, projection)).view(np.uint64)
    return float(((np.bitwise_count(apart) <= RADIUS) & ((apart[:, None] & keys[None, :]) == 0).any(axis=1)).mean())


def learn_rotation(sample: np.ndarray, threshold: float = THRESHOLD, chunks: int = 2, least: float = LEAST_RECALL) -> tuple[np.ndarray, np.ndarray]:
    """Origin and projection for codes of unit vectors: the largest of PARTS of their mean with which planted neighbours are found."""
    mean, few, keys = sample.mean(axis=0), sample[:PLANTED], table_bits(chunks)
    near = neighbours(few, threshold)
    for part in PARTS:
        origin = part * mean
        projection = quantisation(few, origin)
        if not part or min(recall_of(few, x, origin, projection, keys) for x in near) >= least:
            break
    return origin, quantisation(sample, origin)


def codes_of(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The 64-bit codes of unit vectors."""
    return np.packbits((unit - mean) @ projection >= 0, axis=1).view(np.int64).reshape(-1)


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum([0, *(column.value_lengths().to_pylist())])
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def unit_rows(block: np.ndarray) -> np.ndarray:
    """Rows of length 1; divided by their largest component first, so that no square is too large or too small for a double."""
    block = block / np.abs(block).max(axis=1, keepdims=True)
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def _by_width(rows: list[np.ndarray]):
    """Positions and unit vectors of the rows of each width."""
    widths = np.array([len(x) for x in rows])
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield int(width), at, unit_rows(np.array([rows[i] for i in at]))


def sampled(classes: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """``embedding`` of the ``most`` rows of ``classes`` (rep, embedding) with the smallest hashes, in their order, and the stored tables that it reads.

    Rows with a hash far over the share that is wanted are sorted out where they are read, so that no task sends ``most`` rows of its own.
    """
    stored = []
    hashed = classes.select("rep", "embedding", F.xxhash64("rep", "embedding").alias("hash"))
    n = classes.count()
    if n > 2 * most:
        few = materialize(hashed.where(F.col("hash") < F.lit(-(1 << 63) + (2 * most << 64) // n)), "sample")
        stored.append(few)
        hashed = few if few.count() >= most else hashed
    return hashed.orderBy("hash", "rep").limit(most).select("embedding"), stored


def learned(sample: DataFrame, threshold: float, chunks: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Origin and projection for each width of the vectors in ``sample``; learned in a task, only they reach the driver."""

    def run(batches):
        rows = [x for batch in batches for x in _rows(batch.column(0))]
        for width, _, unit in _by_width(rows) if rows else ():
            origin, projection = learn_rotation(unit, threshold, chunks)
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([origin]), pa.array([projection.ravel()])], names=["width", "origin", "projection"])

    models = sample.coalesce(1).mapInArrow(tidy(run), "width int, origin array<double>, projection array<double>")
    return {r.width: (np.array(r.origin), np.array(r.projection).reshape(r.width, BITS)) for r in models.collect()}


def encode(vectors: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``id, label, embedding`` -> ``id, label, width, code``. Widths without a model get random directions."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        known = dict(shared.value)
        for batch in batches:
            rows = _rows(batch.column(2))
            codes = np.zeros(len(rows), np.int64)
            for width, at, unit in _by_width(rows):
                if width not in known:
                    known[width] = np.zeros(width), np.random.default_rng(width).standard_normal((width, BITS))
                codes[at] = codes_of(unit, *known[width])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in rows], pa.int32()), pa.array(codes)], names=["id", "label", "width", "code"])

    return vectors.select("id", "label", "embedding").mapInArrow(tidy(run), f"id long, label {vectors.schema['label'].dataType.simpleString()}, width int, code long")


def retrieved_pairs(codes: np.ndarray, table: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that ``table`` is the first common table of and that differ in at most RADIUS bits. ``keys``: bits of the tables."""
    apart = (codes[i] ^ codes[j]).view(np.uint64)
    use = (np.bitwise_count(apart) <= RADIUS) & (table[i] == table[j]) & ((apart & keys[table[i]]) == 0)
    i, j, apart = i[use], j[use], apart[use]
    if len(i):
        use = ((apart[:, None] & keys[None, :]) == 0).argmax(axis=1) == table[i]
        i, j = i[use], j[use]
    return i, j


def _meetings(chunks: int):
    """The members of each unit that are in a retrieved pair of it."""

    def run(batches):
        keys = table_bits(chunks)
        for units in whole_units(batches):
            codes, table, hit = units["code"].to_numpy(), units["table"].to_numpy(), np.zeros(units.num_rows, bool)
            for i, j in pairs_of_units(units):
                i, j = retrieved_pairs(codes, table, keys, i, j)
                hit[i] = hit[j] = True
            yield from units.select([*UNIT, "block", "table", "id", "code"]).filter(pa.array(hit)).to_batches()

    return run


def _rerank(threshold: float, chunks: int):
    def run(batches):
        keys = table_bits(chunks)
        for units in whole_units(batches):
            ids, copies, codes, table = (units[x].to_numpy() for x in ("id", "copies", "code", "table"))
            rows = _rows(units["embedding"].combine_chunks())
            widths = np.array([len(x) for x in rows])
            unit = np.zeros((len(rows), widths.max()))
            for width, at, block in _by_width(rows):
                unit[at, :width] = block
            found = []
            for i, j in pairs_of_units(units):
                i, j = retrieved_pairs(codes, table, keys, i, j)
                use = (np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold) & (widths[i] == widths[j])
                found.append((i[use], j[use]))
            i, j = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, int) for k in (0, 1))
            yield member_rows(ids, copies, i, j)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, wide_from: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Links of every vector with the others of its label whose cosine is ``threshold`` or more.

    Returns one row per row of ``vectors``: the id column, ``n_links`` (other rows linked directly,
    equal vectors included), ``component_id`` (smallest id reachable by links, itself included) and
    ``kept`` (its id is that smallest one). Rows with a null id or label, and vectors that are null, empty,
    zero or hold null or non-finite components, link with nothing. Vectors of different lengths
    never link. Rows that repeat an id, with the same vector or another, are rows of their own: an id links nothing.
    An empty table gives no rows. ``wide_from``: vectors of a label from which keys have three chunks (24 bits); two (16 bits) for any number without it.
    """
    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    source = source.withColumn("fit", fit)
    classes = source.where("fit").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # a number of its own for each class: ids may repeat
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "label", "embedding", "rep", "copies"), "vectors")

    chunks = 2
    if wide_from is not None:
        largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        chunks = 3 if largest and largest >= wide_from else 2
    few, stored = sampled(classes, sample)
    models = learned(few, threshold, chunks)
    drop(*stored)
    codes = materialize(encode(classes.select(F.col("node").alias("id"), "label", "embedding"), models), "codes")

    shift = lambda chunk: F.expr(f"shiftrightunsigned(code, {chunk * CHUNK}) & {(1 << CHUNK) - 1}")
    bucket = lambda t, key: F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), "label", "width", *map(shift, key)).alias("group"))
    buckets = codes.select("id", "code", F.explode(F.array(*(bucket(t, key) for t, key in enumerate(tables_of(chunks))))).alias("at")).select("id", "code", "at.*")
    kind = "group long, block_a int, block_b int, block int, table int, id long, code long"
    placed = dealt(block_pairs(bucket_blocks(buckets, BLOCK)))
    met = materialize(placed.select(*UNIT, "block", "table", "id", "code").mapInArrow(tidy(_meetings(chunks)), kind), "met")
    units = dealt(unsent(met).join(unsent(classes.select(F.col("node").alias("id"), "copies", "embedding")), "id"))
    compared = materialize(units.select(*UNIT, "block", "table", "id", "code", "copies", "embedding").mapInArrow(tidy(_rerank(threshold, chunks)), MEMBER_ROWS), "compared")
    drop(met, codes)

    found = linked(compared, classes).select("node", "links", "component_id")
    known = unsent(classes.withColumn("fit", F.lit(True))).join(unsent(found), "node", "left")
    out = source.join(unsent(known), ["label", "embedding", "fit"], "left")
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "rep", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "rep", "id"), F.lit(True)).alias("kept"),
    )
