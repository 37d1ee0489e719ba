"""Keyed lookup in JSON-lines files: a sidecar tells where each row stands, and a lookup reads those bytes only.

Files are indexed in ranges, each by one task, so a file of any size spreads over tasks. An index knows the length and time of its
files and the digest of each row: a file that changed since is refused, and a row that isn't what was indexed fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.sources.jsonl import require_unique

#: Bytes of a range that one task indexes, and of a read.
RANGE, BLOCK = 64 << 20, 1 << 20


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def lines_of_range(source: BinaryIO, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes (without line feed) of the lines that begin in [start, end). A line belongs to the range where it begins, however long it is."""
    at = max(start - 1, 0)
    source.seek(at)
    held = b""
    skip = start > 0  # up to the line feed before the first line of the range, which may be its own last byte before start
    while True:
        block = source.read(BLOCK)
        held += block
        while (cut := held.find(b"\n")) >= 0:
            if not skip:
                if at >= end:
                    return
                yield at, held[:cut]
            skip, at, held = False, at + cut + 1, held[cut + 1 :]
        if not block or (not skip and at >= end):
            break
    if held and not skip and at < end:
        yield at, held


def _index_ranges(batches):
    for batch in batches:
        for file, start, end in zip(*(batch.column(x).to_pylist() for x in ("file", "start", "end")), strict=True):
            with _open(file) as source:
                rows = []
                for offset, line in lines_of_range(source, start, end):
                    if line.strip():
                        rows.append((file, offset, len(line), hashlib.sha256(line).hexdigest(), line.decode()))
                    if len(rows) == 1000:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "length", "sha256", "line"])


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, modified`` of the files at a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def build_index(spark: SparkSession, path: str, schema: T.StructType, out: str, size: int = RANGE) -> None:
    """Write the index of JSON-lines files at ``path`` to ``out``: the fields of ``schema`` (the key) of each row, and where it stands.

    A line that is no JSON object with all key fields, or a key that repeats, fails, and then there is no index.
    """
    files = files_of(spark, path)
    ranges = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))))
    ranges = ranges.select("file", "start", F.least(F.col("start") + size, "size").alias("end")).repartition("file", "start")
    rows = ranges.mapInArrow(_index_ranges, "file string, offset long, length long, sha256 string, line string")
    key = F.from_json("line", schema, {"mode": "PERMISSIVE"})
    names = schema.fieldNames()
    whole = F.when(F.forall(F.array(*(F.col(f"key.{x}").isNotNull() for x in names)), lambda x: x), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no key in "), "file", F.lit(" at "), F.col("offset").cast("string"))))
    keyed = rows.withColumn("key", key).where(whole).select(*(F.col(f"key.{x}").alias(x) for x in names), "file", "offset", "length", "sha256")
    require_unique(keyed, *names).write.parquet(f"{out}/rows")
    files.write.parquet(f"{out}/files")  # last: an index without it isn't one


def changed_files(spark: SparkSession, path: str, index: str) -> DataFrame:
    """``file`` of files that are new, gone, or of another length or time than when they were indexed."""
    then, now = spark.read.parquet(f"{index}/files"), files_of(spark, path)
    return then.exceptAll(now).unionByName(now.exceptAll(then)).select("file").distinct()


def read_rows(source: BinaryIO, wanted: Iterable[tuple[int, int, str]]) -> Iterator[str]:
    """The rows at (offset, length, digest), a read each; another digest raises ValueError."""
    for offset, length, digest in wanted:
        source.seek(offset)
        line = source.read(length)
        if hashlib.sha256(line).hexdigest() != digest:
            raise ValueError(f"changed record at byte {offset}")
        yield line.decode()


def _read_ranges(batches):
    for batch in batches:
        rows = batch.select(["file", "offset", "length", "sha256"]).to_pylist()
        out = [""] * len(rows)
        for file in dict.fromkeys(r["file"] for r in rows):
            at = sorted((i for i, r in enumerate(rows) if r["file"] == file), key=lambda i: rows[i]["offset"])
            with _open(file) as source:
                for i, line in zip(at, read_rows(source, ((rows[i]["offset"], rows[i]["length"], rows[i]["sha256"]) for i in at)), strict=True):
                    out[i] = line
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "line"])


def lookup(spark: SparkSession, path: str, index: str, keys: DataFrame) -> DataFrame:
    """``keys`` that the index has, with ``line``, the JSON text of their row. Only these rows' bytes are read.

    Raises ValueError if a file changed since it was indexed.
    """
    other = changed_files(spark, path, index).head(1)
    if other:
        raise ValueError(f"changed since it was indexed: {other[0].file}")
    found = spark.read.parquet(f"{index}/rows").join(keys.distinct(), keys.columns)
    names = [*keys.columns, "file", "offset", "length", "sha256"]
    fields = T.StructType([found.select(*names).schema[x] for x in names] + [T.StructField("line", T.StringType())])
    return found.select(*names).mapInArrow(_read_ranges, fields).select(*keys.columns, "line")
