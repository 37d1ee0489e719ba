"""Feature rows, builder inputs and screening on small made-up rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from memloom.operators import builder, screening
from memloom.operators import features as f


def test_numbers_take_finite_values_only(spark):
    given = ["1.5", " 2 ", "nan", "inf", "3d", "x", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, score string").withColumn("token_count", F.lit(True))
    got = {r.i: r.n for r in rows.select("i", f.numbers(rows).alias("n")).collect()}
    names = list(f.NUMERIC)
    for i, want in enumerate([1.5, 2.0, None, None, None, None, None, None]):
        assert got[i][names.index("retrieval_score")] == got[i][names.index("rrf_score")] == want
        assert got[i][names.index("token_count")] is None


def test_vector_problems(spark):
    given = [([3.0, 4.0], None), (None, "missing"), ([0.0, 0.0], "invalid"), ([1.0], "invalid"), ([], "invalid"), ([float("nan"), 1.0], "invalid"), ([None, 1.0], "invalid"), ([float("inf"), 1.0], "invalid")]
    rows = spark.createDataFrame([(v, str(want)) for v, want in given], "v array<float>, want string")
    assert all(str(r.p) == r.want for r in rows.select("want", f.vector_problem("v", 2).alias("p")).collect())


SCHEMA = "unit int, embedding array<float>, query_vector array<float>, numbers array<double>, speaker string"


def _feature_rows():
    rng = np.random.default_rng(3)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(size=4)]
    numbers = lambda: [None if rng.random() < 0.3 else float(x) for x in rng.normal(size=7)] + [None]
    return [(i % 3, vector(), vector() if i % 4 == 0 else None, numbers(), [None, "", "ann", "bo"][i % 4]) for i in range(20)]


def test_feature_rows_against_numpy(spark):
    rows = _feature_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r.embedding): r.features for r in f.transform(df, f.fit(df), 4, budget=1024.0).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    columns = [[r[3][i] for r in rows if r[3][i] is not None] for i in range(8)]
    means = [np.mean(c) if c else 0.0 for c in columns]
    scales = [max(np.std(c), 1e-6) if c else 1.0 for c in columns]
    for u, embedding, query, numbers, speaker in rows:
        v = unit(embedding)
        c = unit(query) if query else unit(np.mean([unit(r[1]) for r in rows if r[0] == u], axis=0))
        z = [0.0 if x is None else (x - m) / s for x, m, s in zip(numbers, means, scales, strict=True)]
        hot = [float(speaker == x) for x in ("ann", "bo")]
        want = [*v, *c, *(v * c), *abs(v - c), *z, *(float(x is None) for x in numbers), 1.0 - sum(hot), *hot, 0.25]
        assert np.allclose(got[tuple(embedding)], want)


def test_unusable_vectors_raise_and_empty_tables_are_empty(spark):
    good = spark.createDataFrame(_feature_rows(), SCHEMA)
    bad = spark.createDataFrame([(1, [0.0] * 4, None, [None] * 8, "ann")], SCHEMA)
    with pytest.raises(Exception, match="invalid source vector"):
        f.transform(bad, f.fit(good), 4).collect()
    assert f.transform(good.limit(0), f.fit(good), 4).collect() == []
    none = f.fit(good.limit(0)).first()
    assert list(none.means) == [0.0] * 8 and list(none.scales) == [1.0] * 8 and none.speakers == []


def test_builder_input_is_canonical(spark):
    text = 'a "b" \\ \\u000B \x0b \x1f \n / é '
    source = "id int, source_id string, session string, speaker string, time string, position int, source_offset int, text string"
    rows = [([(2, None, "s", None, None, 1, None, None), (1, "x", None, "ann", "t", 0, 5, text)], ("Flat", [1, 2]))]
    df = spark.createDataFrame(rows, f"sources array<struct<{source.replace(' ', ':').replace(',:', ', ')}>>, structure struct<architecture: string, nodes: array<int>>")
    got = df.select(builder.input_json("sources", "structure", F.lit("Flat"), F.lit("c"), "m").alias("t")).first().t
    value = json.loads(got)
    assert got == json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert [s["id"] for s in value["sources"]] == [1, 2]
    assert value["sources"][0]["text"] == text and value["sources"][1]["text"] == "" and value["sources"][1]["source_id"] == "2"
    assert value["sources"][1]["time"] is None


def test_topic_blocks_are_nearest_and_cover_all_rows(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(4)[:3]
    rows = [(i, [float(x) for x in centres[i % 3] + rng.normal(scale=0.05, size=4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = {r.id: r.block for r in screening.topic_blocks(df, 4, 3).collect()}
    assert len(got) == 62 and got[60] is None and got[61] is None
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:60]}
    blocks = {b: np.mean([unit[i] for i in unit if got[i] == b], axis=0) for b in set(got.values()) - {None}}
    for i, v in unit.items():
        assert got[i] == min(blocks, key=lambda b: np.linalg.norm(v - blocks[b]))
        assert min(j for j in unit if got[j] == got[i]) == got[i]
    assert screening.topic_blocks(df.limit(0), 4, 3).collect() == []


def test_salient_units_keep_each_session(spark):
    rows = [(1, 1, 1, 0, ["a", "b"], "t1"), (1, 1, 2, 1, ["c"], "t2"), (1, 2, 3, 0, ["a", "b"], "t3"), (1, 2, 4, 1, ["a"], "t1"), (1, 3, 5, 0, ["z"], "t5"), (2, 9, 6, 0, None, None)]
    df = spark.createDataFrame(rows, "batch int, session int, id int, time int, terms array<string>, text string")
    got = {(r.batch, r.id): r.strength for r in screening.salient(df, 3).collect()}
    assert got == {(1, 1): 1, (1, 3): 1, (1, 5): 0, (2, 6): 0}
    assert len(screening.salient(df, 9).collect()) == 5


def test_strengths_are_those_of_loops_in_any_blocks(spark, monkeypatch):
    import random

    random.seed(3)
    rows = [(b, random.randint(0, 9), 100 * b + i, [f"t{int(random.paretovariate(0.6))}" for _ in range(random.randint(0, 9))] if i else None) for b in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "batch int, session int, id int, terms array<string>")
    want = {(b, i): len({s2 for b2, s2, _, t2 in rows if b2 == b and s2 != s and set(t or []) & set(t2 or [])}) for b, s, i, t in rows}
    for units, held in ((16_384, 4_000_000), (7, 11)):
        monkeypatch.setattr(screening, "UNITS", units)
        monkeypatch.setattr(screening, "HELD", held)
        assert {(r.batch, r.id): r.strength for r in screening.strengths(df).collect()} == want and max(want.values()) > 5


def test_what_salience_moves_does_not_grow_with_pairs(spark, tmp_path):
    # 400 sessions that share their terms, and long texts
    rows = spark.range(800).selectExpr("0 AS batch", "id div 2 AS session", "id", "id AS time", "transform(sequence(1, 20), x -> concat('term', x)) AS terms", "concat_ws(' ', transform(sequence(1, 300), x -> concat(id, 'w', x))) AS text")
    plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    assert "Generate explode(sessions" not in plan(screening.strengths(rows))
    best = screening.salient(rows, 3)
    assert [(r.id, r.strength) for r in best.orderBy("id").collect()] == [(0, 399), (2, 399), (4, 399)] and set(best.columns) == {"batch", "session", "id", "time", "strength"}


def test_frequent_words_are_bounded(spark):
    sets = spark.range(64).selectExpr("sequence(0L, id) AS set")
    words, place = screening.frequent_words(sets, 20)
    assert 5 < len(words) <= 20 and list(words) == list(range(len(words))) and list(place) == list(range(len(words), 0, -1))
    assert len(screening.frequent_words(sets, 0)[0]) == 0


def test_near_copies_are_those_of_all_pairs(spark):
    import random

    random.seed(11)
    rows = []
    for batch in range(3):
        seeds = [[f"w{random.randint(0, 60)}" for _ in range(random.randint(1, 25))] for _ in range(12)] + [[], []]
        for i in range(90):
            words = list(random.choice(seeds))
            for _ in range(random.randint(0, 2)):
                if words and random.random() < 0.7:
                    words[random.randrange(len(words))] = f"w{random.randint(0, 60)}"
            rows.append((batch, i, random.randint(0, 9), words if i else None))
    df = spark.createDataFrame(rows, "batch long, id long, time long, words array<string>").repartition(3)
    for least in (0.5, 0.8, 0.9, 1.0):
        got = {(r.batch, r.id) for r in screening.near_copies(df, least).collect()}
        want = set()
        for b, i, t, w in rows:
            for b2, i2, t2, w2 in rows:
                x, y = set(w or []), set(w2 or [])
                if b == b2 and (t2, i2) < (t, i) and (x == y or len(x & y) >= least * len(x | y)):
                    want.add((b, i))
        assert got == want and want
