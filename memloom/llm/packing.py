"""Harmonic packing of documents into fixed-length training sequences.

Class k holds pieces of which exactly k fill a sequence of ``capacity`` tokens: their length is
floor(capacity / k). A document gives whole sequences first (class 1); its rest is cut greedily
into the largest class length that fits, again and again, until a piece of at most ``smallest``
tokens is left, which has a class of its own length. Any rest takes a handful of pieces, and a
sequence of class k wastes less than k tokens.

Each class fills its sequences with a fixed number of pieces: piece number n of a class lies in the
class's sequence n div k at slot n mod k. Numbers come from counts per class and shard, so shards
are filled independently of each other, by any number of workers, and no class needs to be in
one place. Of each class fewer than k pieces are left over in the end. Those are a constant number,
whatever the size of the corpus, and are packed first-fit by falling length in one small task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.arrow_text import tidy
from memloom.llm.bpe import tokenizer
from memloom.sources.scratch import materialize

#: Rests up to this length stay whole.
SMALLEST = 32


def cut_lengths(tokens: int, capacity: int, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of a document, in order. Every length but the last is a class length.

    >>> cut_lengths(2500, 1024)
    [1024, 1024, 341, 102, 9]
    """
    whole, rest = divmod(tokens, capacity)
    lengths = [capacity] * whole
    while rest > smallest:
        piece = capacity // -(-capacity // rest)
        lengths.append(piece)
        rest -= piece
    return [*lengths, rest] if rest else lengths


def _shards(df: DataFrame) -> int:
    """Shards of a class: as many as shuffle partitions, so that no class is a hot key."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cut(docs: DataFrame, path: str, end_id: int, capacity: int, smallest: int, id_column: str, text_column: str) -> DataFrame:
    key = docs.schema[id_column]
    long = T.LongType()
    schema = T.StructType([key, *(T.StructField(x, long) for x in ("start", "length", "ids_crc32", "doc_tokens"))])

    def run(batches):
        bpe = tokenizer(path)
        known: dict[int, list[int]] = {}
        for batch in batches:
            for row, end, ids, at in bpe.encode(batch.column(1)):
                rows, starts, lengths, sums, sizes = [], [], [], [], []
                for i in range(end - row):
                    text = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4", copy=False)
                    cuts = known.get(len(text)) or known.setdefault(len(text), cut_lengths(len(text), capacity, smallest))
                    start = 0
                    for n in cuts:
                        rows.append(i)
                        starts.append(start)
                        lengths.append(n)
                        sums.append(zlib.crc32(text[start : start + n]))
                        sizes.append(len(text))
                        start += n
                if len(known) > 50_000:
                    known.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, sizes))], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(tidy(run), schema)


def _fit_leftovers(capacity: int):
    """First fit by falling length, for the bounded leftovers of all classes."""

    def run(pieces):
        pieces = pieces.sort_values(["length", "number"], ascending=[False, True], kind="stable")
        free: list[int] = []
        bins, offsets = [], []
        for n in pieces["length"]:
            b = next((i for i, room in enumerate(free) if room >= n), len(free))
            if b == len(free):
                free.append(capacity)
            bins.append(b)
            offsets.append(capacity - free[b])
            free[b] -= n
        return pieces.assign(sequence_id=pieces["all_full"] + bins, offset=offsets)[["length", "number", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, smallest: int = SMALLEST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack every document of ``docs`` into sequences of at most ``capacity`` tokens.

    A document is the ids of its whole text (null counts as empty) and ``end_id``. Returns one row
    per piece: the id column, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of its ids as unsigned 32-bit little-endian integers), ``doc_tokens``,
    ``sequence_id`` (gapless from 0) and ``offset`` in the sequence (gapless from 0). Each id of a
    document lies in one piece. Rows with equal ids or equal texts are packed each for itself; an
    empty table gives no rows.

    The pieces are written as a table in the shared folder first: they are numbered twice (counts,
    then numbers), and texts shall be encoded once. Only piece rows are shuffled, never ids.
    """
    pieces = _cut(docs, path, end_id, capacity, smallest, id_column, text_column)
    # a class is known by its length; fill: its pieces per sequence
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64(id_column, "start"), F.lit(_shards(docs))).cast("int"))
    pieces = materialize(pieces, "pieces")

    # at most (classes x shards) rows, whatever the corpus
    counts = pieces.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "shard", F.expr(f"{capacity} div length").alias("fill"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("total"))
    classes = counts.groupBy("length").agg(F.expr("max(total) div max(fill)").alias("full"))
    lower = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    classes = classes.select("length", F.coalesce(F.sum("full").over(lower), F.lit(0)).alias("base"), F.sum("full").over(every).alias("all_full"))
    counts = materialize(counts.join(classes, "length"), "pack-counts")

    within = Window.partitionBy("length", "shard").orderBy(F.col(id_column), F.col("start"))
    numbered = pieces.withColumn("in_shard", F.row_number().over(within)).join(counts, ["length", "shard"])
    numbered = numbered.withColumn("number", F.expr("before + in_shard - 1"))
    numbered = materialize(numbered.select(id_column, "start", "length", "ids_crc32", "doc_tokens", "fill", "number", "base", "all_full", F.expr("number >= total - total % fill").alias("left_over")), "numbered")

    columns = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = numbered.where("not left_over").withColumns({"sequence_id": F.expr("base + number div fill"), "offset": F.expr("number % fill * length")})
    rest = numbered.where("left_over")
    fitted = rest.select("length", "number", "all_full").groupBy("all_full").applyInPandas(_fit_leftovers(capacity), "length long, number long, sequence_id long, offset long")
    return full.select(*columns).unionByName(rest.join(fitted, ["length", "number"]).select(*columns))
