"""JSON lines: strict reading, journals with a quarantine of torn appends, digests, and writing."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON-lines files; a missing path has none, a broken line fails the job when it is read."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _journal_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that are not blank with ``row``, whether ``torn``, ``file`` and ``at``, their place in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    parsed = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    return parsed.withColumn("torn", F.col(f"row.{_CORRUPT}").isNotNull())


def read_journal(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and torn last lines (``line``, ``file``) for quarantine: an append that was cut short costs its own line only.

    A broken line with others behind it in its file is no torn append, and raises ValueError. A missing path has no rows.
    """
    try:
        parsed = _journal_lines(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string, file string")
    last = parsed.groupBy("file").agg(F.max("at").alias("last"))
    middle = parsed.where("torn").join(last, "file").where("at < last").select("file", "value").head(1)
    if middle:
        raise ValueError(f"corrupt record within {middle[0].file}: {middle[0].value[:80]}")
    return parsed.where("NOT torn").select("row.*").drop(_CORRUPT), parsed.where("torn").select(F.col("value").alias("line"), "file")


def index_journal(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Good rows of a journal with ``file`` and ``sha256`` of their line, failing when read if a key repeats."""
    read_journal(spark, path, schema)  # raises where a line in the middle is broken
    good = _journal_lines(spark, path, schema).where("NOT torn")
    return require_unique(good.select("row.*", "file", F.sha2("value", 256).alias("sha256")).drop(_CORRUPT), key)


def verified(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows of an index (:func:`index_journal`) with the digest that an earlier ``index`` (key, sha256) says; another one, or a lost row, fails when read."""
    then = index.select(key, F.col("sha256").alias("_then"))
    both = then.join(rows, key, "left")
    same = F.when(F.coalesce(F.col("sha256") == F.col("_then"), F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("changed or lost record: "), F.col(key).cast("string"))))
    return both.where(same).drop("_then")


def require_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows``, failing when read if a key repeats. The check is one aggregate beside the rows."""
    repeats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    checked = repeats.withColumn("_once", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.concat_ws(", ", *keys)))).otherwise(F.lit(True)))
    return rows.join(checked.select(*keys, "_once"), list(keys)).where("_once").drop("_once")


def _written(rows: DataFrame, path: str, mode: str) -> int:
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Write rows as JSON lines, null fields kept, with Spark's commit of whole jobs. Returns their number."""
    return _written(rows, path, "overwrite")


def append_jsonl(rows: DataFrame, path: str) -> int:
    """Add rows to a folder of JSON lines. Returns their number."""
    return _written(rows, path, "append")


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of whole JSON documents: ``file``, ``document`` (variant); a file that is no JSON fails when it is read."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.parse_json("value").alias("document"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, length, sha256`` of every file below a folder: the inputs of a run for its manifest."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def write_document(spark: SparkSession, path: str, document: dict | list) -> None:
    """Write one JSON document with sorted keys as the only file of a folder: there as a whole or not at all."""
    text = json.dumps(document, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_manifest(spark: SparkSession, path: str, inputs: dict[str, str], facts: dict) -> dict:
    """Write what a run read, by the digest of all files of each input, and further ``facts``; returns the document.

    An input's digest is that of the sorted lines ``name length sha256`` of its files, so it doesn't depend on the order in which they are listed.
    """
    found = {}
    for name, at in inputs.items():
        files = file_digests(spark, at).select(F.element_at(F.split("file", "/"), -1).alias("name"), "length", "sha256")
        line = F.concat_ws(" ", "name", "length", "sha256")
        row = files.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("sha256")).first()
        found[name] = {"path": at, "files": row.files, "bytes": row.bytes or 0, "sha256": row.sha256}
    document = {"inputs": found, **facts}
    write_document(spark, path, document)
    return document
