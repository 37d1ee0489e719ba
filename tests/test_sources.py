"""JSON lines, journals and intermediate tables."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.sources import jsonl, scratch, snapshots

ROW = T.StructType([T.StructField("qa_id", T.StringType()), T.StructField("n", T.LongType())])


def test_missing_file_is_empty_and_rows_round_trip(spark, tmp_path):
    assert jsonl.read_jsonl(spark, f"{tmp_path}/none", ROW).count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", None)], ROW)
    jsonl.write_jsonl(rows, f"{tmp_path}/out")
    assert '"n":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert sorted(map(tuple, jsonl.read_jsonl(spark, f"{tmp_path}/out", ROW).collect())) == [("a", 1), ("b", None)]


def test_strict_reading_fails_and_a_journal_quarantines_its_torn_line(spark, tmp_path):
    path = tmp_path / "journal.jsonl"
    path.write_text('{"qa_id": "a", "n": 1}\n\n{"qa_id": "b", "n"')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        jsonl.read_jsonl(spark, str(path), ROW).collect()
    good, torn = jsonl.read_journal(spark, str(path), ROW)
    assert [tuple(r) for r in good.collect()] == [("a", 1)]
    assert [r.line for r in torn.collect()] == ['{"qa_id": "b", "n"']


def test_a_broken_line_in_the_middle_raises(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.jsonl").write_text('{"qa_id": "a", "n": 1}\n{"qa_id": "b", \n{"qa_id": "c", "n": 2}\n')
    (tmp_path / "a" / "2.jsonl").write_text('{"qa_id": "d", "n": 1}\n{"qa_i')
    with pytest.raises(ValueError, match="corrupt record within"):
        jsonl.read_journal(spark, f"{tmp_path}/a", ROW)
    (tmp_path / "a" / "1.jsonl").write_text('{"qa_id": "a", "n": 1}\n{"qa_id": "c", "n": 2}')
    good, torn = jsonl.read_journal(spark, f"{tmp_path}/a", ROW)
    assert sorted(r.qa_id for r in good.collect()) == ["a", "c", "d"] and [r.line for r in torn.collect()] == ['{"qa_i']
    good, torn = jsonl.read_journal(spark, f"{tmp_path}/none", ROW)
    assert good.count() == torn.count() == 0


def test_appending_counts_and_records_are_verified(spark, tmp_path):
    path = f"{tmp_path}/j"
    assert jsonl.append_jsonl(spark.createDataFrame([("a", 1), ("b", 2)], ROW), path) == 2
    index = spark.createDataFrame(jsonl.index_journal(spark, path, ROW, "qa_id").select("qa_id", "sha256").collect())
    assert jsonl.append_jsonl(spark.createDataFrame([("c", 3)], ROW), path) == 1
    now = jsonl.index_journal(spark, path, ROW, "qa_id")
    assert {r.qa_id: r.n for r in jsonl.verified(now, index, "qa_id").collect()} == {"a": 1, "b": 2}
    with pytest.raises(Exception, match="changed or lost record: a"):
        jsonl.verified(now.where("qa_id <> 'a'"), index, "qa_id").collect()
    jsonl.append_jsonl(spark.createDataFrame([("a", 1)], ROW), path)
    with pytest.raises(Exception, match="duplicate key: a"):
        jsonl.index_journal(spark, path, ROW, "qa_id").collect()
    assert jsonl.write_jsonl(spark.createDataFrame([("z", 1)], ROW), path) == 1
    assert jsonl.file_digests(spark, path).where("file LIKE '%.json'").count() >= 1
    (tmp_path / "doc.json").write_text('{\n "a": [1, 2]\n}')
    assert jsonl.read_document(spark, f"{tmp_path}/doc.json").selectExpr("variant_get(document, '$.a[1]', 'int') AS x").first().x == 2


def test_snapshots(spark, tmp_path):
    entries, sources = spark.createDataFrame([(1, "m")], "memory long, m string"), spark.createDataFrame([(1, "s")], "memory long, source_id string")
    for version in (1, 2):
        snapshots.save(entries.withColumn("version", F.lit(version)), sources, f"{tmp_path}/s", version)
    assert [r.version for r in snapshots.load(spark, f"{tmp_path}/s")[0].collect()] == [2]
    assert [r.version for r in snapshots.load(spark, f"{tmp_path}/s", 1)[0].collect()] == [1]
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.load(spark, f"{tmp_path}/s", 3)


def test_tables_no_longer_read_are_deleted_and_plain_paths_get_their_scheme(spark, tmp_path):
    made = scratch.materialize(spark.range(10), "numbers")
    (file,) = {f.rsplit("/", 1)[0].removeprefix("file://") for f in made.inputFiles()}
    assert os.path.isdir(file)
    scratch.drop(made)
    assert not os.path.exists(file)
    scratch.drop(made, spark.range(1))  # nothing left to delete
    assert scratch.qualified(spark, str(tmp_path)).startswith("file:/")


def test_repeated_keys_raise(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], ROW)
    with pytest.raises(Exception, match="duplicate key: a"):
        jsonl.require_unique(rows, "qa_id").collect()
    assert jsonl.require_unique(rows.where("n = 1"), "qa_id").count() == 2


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = scratch.materialize(spark.range(10), "numbers")
    assert df.count() == 10
    assert all(f.startswith(scratch.shared_root(spark)) or f.removeprefix("file://").startswith(scratch.shared_root(spark).removeprefix("file://")) for f in df.inputFiles())
    assert scratch.materialize(spark.range(0), "none").count() == 0
