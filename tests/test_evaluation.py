"""Evaluation runs, sampling, paired results, integrity, replies and keyed lookup."""

import io
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators import builder, evaluation, integrity
from memloom.sources import lookup

ANSWERS = "q long, arm string, status string, error string, usage_complete boolean, score double"


class TestRuns:
    def planned(self, spark):
        return evaluation.tasks(spark.range(30).withColumnRenamed("id", "q"))

    def answer(self, asked, fails=lambda q, arm: False, stop_at=None):
        def run(rows):
            keys = [(r.q, r.arm) for r in rows.collect()]
            if stop_at is not None and len(asked) >= stop_at:
                raise RuntimeError("stopped")
            asked.append(keys)
            bad = F.udf(fails, "boolean")("q", "arm")
            return rows.select("q", "arm", F.when(bad, "agent_error").otherwise("ok").alias("status"), F.when(bad, "timeout").alias("error"), (~bad).alias("usage_complete"), F.lit(0.5).alias("score"))

        return run

    def test_a_stopped_run_goes_on_and_answers_each_task_once(self, spark, tmp_path):
        path, asked = str(tmp_path / "journal"), []
        with pytest.raises(RuntimeError):
            evaluation.run(self.planned(spark), ["q", "arm"], self.answer(asked, stop_at=2), path, ANSWERS, 1, batches=4)
        assert 0 < spark.read.parquet(path).count() < 150
        assert evaluation.run(self.planned(spark), ["q", "arm"], self.answer(asked), path, ANSWERS, 2, batches=4) == 2
        everything = [k for keys in asked for k in keys]
        assert len(everything) == len(set(everything)) == 150
        journal = evaluation.read_journal(spark, path, ANSWERS)
        assert journal.count() == 150 and {r["try"] for r in journal.select("try").distinct().collect()} == {1, 2}
        # the same journal as that of a run that wasn't stopped
        whole = str(tmp_path / "whole")
        evaluation.run(self.planned(spark), ["q", "arm"], self.answer([]), whole, ANSWERS, 1, batches=4)
        rows = lambda p: sorted(tuple(r) for r in evaluation.read_journal(spark, p, ANSWERS).drop("try").collect())
        assert rows(path) == rows(whole)
        assert evaluation.run(self.planned(spark), ["q", "arm"], self.answer(asked), path, ANSWERS, 3, batches=4) == 0

    def test_failed_tasks_are_tried_again_and_the_good_row_wins(self, spark, tmp_path):
        path, asked = str(tmp_path), []
        evaluation.run(self.planned(spark), ["q", "arm"], self.answer(asked, lambda q, arm: q % 3 == 0), f"{path}/j", ANSWERS, 1)
        evaluation.run(self.planned(spark), ["q", "arm"], self.answer(asked, lambda q, arm: q == 0), f"{path}/j", ANSWERS, 2)
        assert Counter(q for keys in asked for q, _ in keys) == {q: 10 if q % 3 == 0 else 5 for q in range(30)}
        got = evaluation.results(evaluation.read_journal(spark, f"{path}/j", ANSWERS), ["q", "arm"]).collect()
        assert len(got) == 150 and all(r.done == (r.q != 0) and r["try"] == (2 if r.q % 3 == 0 else 1) for r in got)

    def test_contexts_of_the_arms(self, spark):
        rows = [(1, 10, 2, 5, True), (1, 11, 1, 9, False), (1, 12, 3, 4, True), (1, 13, None, 1, True), (2, 20, None, 3, False)]
        frame = spark.createDataFrame(rows, "question long, source long, rank int, cost long, chosen boolean")
        got = {(r.question, r.arm): (r.sources, r.cost) for r in evaluation.contexts(frame, budget=13, most=1).collect()}
        assert got == {
            (1, "no_memory"): ([], 0), (1, "full_memory"): ([11, 10, 12], 18), (1, "naive_rag"): ([11], 9), (1, "rank_pack"): ([11, 12], 13), (1, "our"): ([10, 12, 13], 10),
            (2, "no_memory"): ([], 0), (2, "full_memory"): ([], 0), (2, "naive_rag"): ([], 0), (2, "rank_pack"): ([], 0), (2, "our"): ([], 0),
        }
        for arms in ((), ("our", "our"), ("other",)):
            with pytest.raises(ValueError, match="arms"):
                evaluation.contexts(frame, 1, 1, arms)


def test_samples_are_seeded_without_replacement_and_per_stratum(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(400)], "id long, s string").repartition(6)
    ids = lambda df: sorted(r.id for r in df.collect())
    one, again, other = (ids(evaluation.sampled(df, 50, "id", seed)) for df, seed in ((rows, 7), (rows.repartition(2), 7), (rows, 8)))
    assert one == again != other and len(set(one)) == 50
    assert ids(evaluation.sampled(rows, 999, "id", 7)) == list(range(400))
    parts = evaluation.sampled(rows, 30, "id", 7, "s")
    assert {r.s: r["count"] for r in parts.groupBy("s").count().collect()} == {"a": 30, "b": 30}
    assert ids(parts.where("s = 'b'")) == ids(evaluation.sampled(rows.where("s = 'b'"), 30, "id", 7))
    first = evaluation.limited(rows, ["s", "id"], 3)
    assert [(r.id, r.place) for r in first.orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert evaluation.limited(rows, ["s"]).count() == 400


def test_a_failed_call_is_unknown_and_not_zero(spark):
    rows = [("a", "gold_oracle", "ok", 1.0, 1.0, 10), ("a", "full_memory", "ok", 0.5, 0.0, 40), ("b", "gold_oracle", "builder_error", 0.0, 0.0, 10), ("b", "full_memory", "ok", 1.0, 1.0, 40),
            ("c", "gold_oracle", "empty_memory", 0.0, 0.0, 0), ("c", "full_memory", "ok", 1.0, 1.0, 0), ("d", "gold_oracle", "ok", 1.0, 1.0, 1)]
    pairs = evaluation.paired_oracle(spark.createDataFrame(rows, "q string, arm string, status string, score double, exact double, tokens long"), ["q"])
    got = {r.q: (r.gold_score, r.full_score, r.measured, r.token_saving) for r in pairs.collect()}
    assert got == {"a": (1.0, 0.5, True, 0.75), "b": (None, 1.0, False, 0.75), "c": (0.0, 1.0, True, None), "d": (1.0, None, False, None)}
    assert tuple(evaluation.oracle_summary(pairs).first()) == (2, 2, 0.5, 0.75, 0.5, 0.5, 0.75)


def test_each_planted_defect_is_named_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", 1), (2, None, 0), (2, "yy", 2), (3, "", -1)], "id long, t string, n long")
    rules = {"has text": F.length("t") > 0, "n is the length": F.col("n") == F.length("t"), "n is not negative": F.col("n") >= 0}
    plan = integrity.violations(rows, rules)
    want = {"has text": 2, "n is the length": 2, "n is not negative": 1}
    assert {r.constraint: r.violations for r in plan.collect()} == want
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    checked, seen = integrity.observed(rows, rules)
    checked.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"rows": 4, **want}
    assert [tuple(r) for r in integrity.repeated_keys(rows, "id").collect()] == [(2, 2)]
    part = lambda *x: spark.createDataFrame(list(x), "id long, digest string")
    got = integrity.disagreements({"calls": part((1, "a"), (2, "b"), (3, "c")), "rows": part((1, "a"), (1, "a"), (3, "x")), "asked": part((1, "a"), (2, "b"), (3, "c"), (4, "d"))}, "id")
    assert sorted(map(tuple, got.collect())) == [(1, "repeated", "rows"), (2, "missing", "rows"), (3, "differs", "asked,calls,rows"), (4, "missing", "calls,rows")]


def test_only_one_missing_root_brace_is_mended(spark):
    good = '{"requirements":[{"id":"r1","text":"a ] b","packages":[[4]]}]}'
    cases = {
        good: (None, None), good[:-1]: (builder.REPAIRED, None), good[:-3]: (None, "parse_error"), good[:-2]: (None, "parse_error"), f"why\n```json\n{good}\n```": (None, None), f"```\n{good[:-1]}\n```": (builder.REPAIRED, None),
        "[1]": (None, "root_not_object"), "": (None, "parse_error"), '{"other":[1]': (None, "parse_error"), '{"requirements":[1],"more":[2]': (None, "parse_error"), '{"requirements":[': (None, "parse_error"), good + "]": (None, "parse_error"),
    }
    rows = builder.teacher_reply(spark.createDataFrame([(x,) for x in cases] + [(None,)], "raw string")).withColumn("json", F.to_json("reply")).collect()
    assert {r.raw: (r.repair, r.error) for r in rows} == cases | {None: (None, "parse_error")}
    assert all(json.loads(r.json) == json.loads(good) for r in rows if r.repair)


class Counted(io.BytesIO):
    reads = 0

    def read(self, n=-1):
        self.reads += 1
        return super().read(n)


class TestLookup:
    SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("qa_id", T.LongType())])

    def write(self, folder, lines, name="a.jsonl"):
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{name}", "wb") as f:
            f.write("\n".join(lines).encode())

    def rows(self, n=300):
        random.seed(1)
        return [json.dumps({"sample_id": f"s{i % 7}", "qa_id": i, "text": "é" * random.randint(0, 90)}, ensure_ascii=False) for i in range(n)]

    @pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
    def test_ranges_find_every_line_once(self, size):
        text = ("\n".join(self.rows(40)) + "\n\n" + "x" * 300 + "\nlast").encode()
        found = [x for start in range(0, len(text), size) for x in lookup.lines_of_range(io.BytesIO(text), start, min(start + size, len(text)))]
        assert [line for _, line in found] == text.split(b"\n")
        assert all(text[at : at + len(line)] == line for at, line in found)

    def test_ten_keys_read_ten_ranges(self, spark, tmp_path):
        folder, index, rows = str(tmp_path / "in"), str(tmp_path / "index"), self.rows()
        self.write(folder, rows[:200])
        self.write(folder, [*rows[200:], ""], "b.jsonl")
        lookup.build_index(spark, folder, self.SCHEMA, index, size=500)
        assert spark.read.parquet(f"{index}/rows").count() == 300
        wanted = [(f"s{i % 7}", i) for i in range(5, 300, 30)]
        got = lookup.lookup(spark, folder, index, spark.createDataFrame([*wanted, ("s0", 1), wanted[0]], "sample_id string, qa_id long"))
        assert sorted((r.qa_id, r.line) for r in got.collect()) == sorted((i, rows[i]) for _, i in wanted)
        places = [(r.offset, r.length, r.sha256) for r in spark.read.parquet(f"{index}/rows").where("file LIKE '%a.jsonl' AND qa_id % 20 = 3").collect()]
        source = Counted(open(f"{folder}/a.jsonl", "rb").read())
        assert len(places) == 10 and len(list(lookup.read_rows(source, places))) == source.reads == 10

    def test_changed_files_and_rows_are_refused(self, spark, tmp_path):
        folder, index, rows = str(tmp_path / "in"), str(tmp_path / "index"), self.rows(20)
        self.write(folder, rows)
        lookup.build_index(spark, folder, self.SCHEMA, index)
        keys = spark.createDataFrame([("s3", 3)], "sample_id string, qa_id long")
        stat = os.stat(f"{folder}/a.jsonl")
        self.write(folder, [x.replace('"s3"', '"sX"') for x in rows])
        os.utime(f"{folder}/a.jsonl", ns=(stat.st_atime_ns, stat.st_mtime_ns + 5_000_000_000))
        with pytest.raises(ValueError, match="changed"):
            lookup.lookup(spark, folder, index, keys)
        os.utime(f"{folder}/a.jsonl", ns=(stat.st_atime_ns, stat.st_mtime_ns))  # as if nothing had been
        with pytest.raises(Exception, match="changed record"):
            lookup.lookup(spark, folder, index, keys).collect()
        self.write(folder, rows[:2], "c.jsonl")
        with pytest.raises(ValueError, match="changed"):
            lookup.lookup(spark, folder, index, keys)

    @pytest.mark.parametrize("line", ['{"sample_id":"s1"}', "[1]", "{", '{"sample_id":"s0","qa_id":0}'])
    def test_bad_lines_and_repeated_keys_fail(self, spark, tmp_path, line):
        self.write(str(tmp_path / "in"), [*self.rows(3), line])
        with pytest.raises(Exception, match="no key in|duplicate key"):
            lookup.build_index(spark, str(tmp_path / "in"), self.SCHEMA, str(tmp_path / "index"))
        assert not os.path.exists(f"{tmp_path}/index/files")


def test_sources_are_selected_and_dropped_as_a_loop_does(spark):
    from memloom.operators import packing

    random.seed(12)
    rows = []
    for q in range(40):
        for rank, s in enumerate(random.sample(range(100), random.randint(0, 9)), 1):
            known = random.random() < 0.8
            v = [random.random(), random.random()]
            rows.append((q, s, rank, known, random.randint(1, 9) if known else None, random.randint(1, 12) if known else None, [0.6, 0.8], v))
    want = {}
    for q in range(40):
        n = body = whole = 0
        for _, s, rank, known, tokens, cost, a, v in sorted((r for r in rows if r[0] == q), key=lambda r: r[2]):
            fits = known and n < 4 and body + tokens <= 15 and whole + cost <= 20
            if fits:
                n, body, whole = n + 1, body + tokens, whole + cost
            want[q, s] = (rank, fits, n if fits else None, pytest.approx(a[0] * v[0] + a[1] * v[1]) if known else None)
    schema = "question long, source long, rank long, known boolean, tokens long, cost long, q array<double>, v array<double>"
    got = packing.select_sources(spark.createDataFrame(rows, schema), 4, 15, 20)
    assert {(r.question, r.source): (r["rank"], r.selected, r.place, r.cosine) for r in got.collect()} == want
    for bad in ((1, 1, 1, True, None, 1, [1.0], [1.0]), (1, 1, 1, True, 1, 1, [1.0], None)):
        with pytest.raises(Exception, match="missing frozen"):
            packing.select_sources(spark.createDataFrame([bad], schema), 4, 15, 20).collect()


def test_renderings(spark):
    from memloom.operators import rendering

    kind = "b array<struct<source_id:string,dia_id:string,time:string,speaker:string,text:string>>, m array<struct<m:string,src:array<long>>>, h string, p string"
    rows = spark.createDataFrame([([("s1", None, "", "Ann", "hi\nyou"), ("s2", "D1", "May", None, None)], [("x", [1, 2]), (None, None)], "a-b", " p "), ([], [], None, None)], kind)
    got = rows.select(rendering.sources_text(F.col("b")).alias("s"), rendering.packet_text(F.col("b"), F.col("h"), F.col("p")).alias("k"), rendering.packet_text(F.col("b"), F.col("h")).alias("n"), rendering.build_text(F.col("m"), F.lit("Flat"), F.lit(None)).alias("t")).collect()
    lines = "[1] source_id=s1 dia_id= date=unknown time speaker=Ann: hi\nyou\n[2] source_id=s2 dia_id=D1 date=May speaker=: "
    head = "Task-scoped memory packet.\nUse only this packet as supplied memory for the current task.\n"
    assert tuple(got[0]) == (f"Evidence:\n{lines}", f"{head}p\nOriginal evidence:\n{lines}\nRelationship hints:\na-b", f"{head}Original evidence:\n{lines}\nRelationship hints:\na-b", "Architecture: Flat\nTopology: {}\n- x [src:1,2]\n-  [src:]")
    none = f"{head}Original evidence: (empty)\nRelationship hints: (none)"
    assert tuple(got[1]) == ("Evidence:", none, none, "")


def test_compiler_rows_by_hand(spark):
    from memloom.operators import requirements

    cache = spark.createDataFrame([("a", "q1", "who?", 0, None, {"1": [1.0], "2": [2.0]}), ("a", "q2", None, 1, "m", {"2": [9.0], "3": [3.0]}), ("a", "q3", "x", 2, "n", None)], "sample_id string, qa_id string, question string, place long, model string, vectors map<string,array<double>>")
    vectors, models = requirements.frozen_vectors(cache)
    assert {(r.sample_id, r.source_id): r.vector for r in vectors.collect()} == {("a", "1"): [1.0], ("a", "2"): [9.0], ("a", "3"): [3.0]}
    assert [tuple(r) for r in models.collect()] == [("a", "m")]
    blocks = spark.createDataFrame([("a", 2, 0, "3", "t3", 5, 5), ("a", 0, 0, "1", "t1", 5, 5), ("a", 1, 0, "2", "t2", 50, 5), ("a", 3, 0, "4", "no vector", 1, 1), ("b", 0, 0, "9", "no model", 1, 1)], "sample_id string, turn_index long, chunk_index long, source_id string, text string, token_count long, cost long")
    sources = requirements.history_sources(blocks, vectors, models, 5, 20, 20)
    questions = spark.createDataFrame([("a", "q1", "Kim", 2)], "sample_id string, qa_id string, answer string, category long")
    got = {r.qa_id: (r.question, [(s.id, s.source_id, s.vector) for s in r.sources], tuple(r.future_queries[0])) for r in requirements.compiler_rows(cache, sources, questions).collect()}
    picked = [(1, "1", [1.0]), (2, "3", [3.0])]
    assert got == {"q1": ("who?", picked, ("who?", "Kim", 2)), "q2": ("", picked, ("", None, None)), "q3": ("x", picked, ("x", None, None))}
    lone = cache.withColumn("sample_id", F.lit("b"))
    with pytest.raises(Exception, match="no compiler sources selected for b"):
        requirements.compiler_rows(lone, sources, questions).collect()


def test_documents_and_manifests(spark, tmp_path):
    from memloom.sources import jsonl

    os.makedirs(tmp_path / "in")
    for name, text in (("b.txt", "two"), ("a.txt", "é")):
        (tmp_path / "in" / name).write_text(text)
    document = jsonl.write_manifest(spark, str(tmp_path / "m"), {"raw": str(tmp_path / "in")}, {"items": 2})
    read = jsonl.read_document(spark, str(tmp_path / "m")).select(F.to_json("document").alias("x")).collect()
    assert len(read) == 1 and json.loads(read[0].x) == document
    assert (document["items"], document["inputs"]["raw"]["files"], document["inputs"]["raw"]["bytes"]) == (2, 2, 5)
    (tmp_path / "in" / "a.txt").write_text("e!")
    assert jsonl.write_manifest(spark, str(tmp_path / "m"), {"raw": str(tmp_path / "in")}, {})["inputs"]["raw"]["sha256"] != document["inputs"]["raw"]["sha256"]
