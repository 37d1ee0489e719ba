"""Resampling: the generator, the counts, and what they give."""

import numpy as np
import pytest

from memloom.operators import bootstrap


def test_counts_are_those_of_the_statement_and_nearly_poisson(spark):
    ids = np.array([0, 5, 77, 3_000_000_019])
    got = bootstrap.counts(ids, 50, 7)
    frame = spark.createDataFrame([(int(i), d) for i in ids for d in range(1, 51)], "id long, draw long")
    sql = frame.selectExpr("id", "draw", f"{bootstrap.counts_sql(bootstrap.pick_sql('id', 'draw', 7))} AS n").collect()
    assert {(r.id, r.draw): r.n for r in sql} == {(int(i), d): int(got[k, d - 1]) for k, i in enumerate(ids) for d in range(1, 51)}
    many = bootstrap.counts(np.arange(3000), 400, 3)
    assert np.bincount(many.ravel(), minlength=4)[:4] / many.size == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.002)
    # rows are independent of each other, and so are draws
    assert abs(np.corrcoef(many[:, :60].T) - np.eye(60)).max() < 0.1 and abs(np.corrcoef(many[:60]) - np.eye(60)).max() < 0.25


def test_means_by_hand_and_their_spread(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, float(x)) for i, x in enumerate(rng.normal(2, 3, 900))] + [("b", 3, 1.5), ("c", 1, None)] + [("d", i, 0.25) for i in range(5)]
    got = bootstrap.resampled_means(spark.createDataFrame(rows, "g string, id long, gap double").repartition(5), "g", 500, 7).collect()
    gaps = np.array([x for g, _, x in rows if g == "a"])
    often = bootstrap.counts(np.arange(900), 500, 7)
    assert {r.draw: r["mean"] for r in got if r.g == "a"} == pytest.approx(dict(zip(range(1, 501), gaps @ often / often.sum(axis=0))))
    means = np.array([r["mean"] for r in got if r.g == "a"])
    assert means.std() == pytest.approx(3 / 30, rel=0.15) and means.mean() == pytest.approx(gaps.mean(), abs=0.02)
    assert {r["mean"] for r in got if r.g == "b"} == {1.5, None} and not [r for r in got if r.g == "c"]
    assert {r["mean"] for r in got if r.g == "d"} <= {0.25, None}


def test_each_draw_picks_as_many_rows_as_the_group_has(spark):
    rng = np.random.default_rng(5)
    rows = [("a", 3 * i, float(x)) for i, x in enumerate(rng.normal(2, 3, 300))] + [("b", 3, 1.5), ("c", 1, None)] + [("d", 7 * i, float(i)) for i in range(3)]
    frame = spark.createDataFrame(rows, "g string, id long, gap double").repartition(5)
    for block in (bootstrap.BLOCK, 64):  # a block for each group, and several
        got = bootstrap.picked_means(frame, "g", 120, 7, block).collect()
        for g in "abd":
            gaps = np.array([x for name, _, x in rows if name == g])
            picks = bootstrap.numbers(np.arange(1, len(gaps) + 1), np.arange(1, 121), 7) % len(gaps)
            assert {r.draw: r["mean"] for r in got if r.g == g} == pytest.approx(dict(zip(range(1, 121), gaps[picks].mean(axis=0))))
        assert not [r for r in got if r.g == "c"]
    # no draw is void, however small the group
    assert sum(r.g == "b" and r["mean"] == 1.5 for r in got) == 120


def test_interval_of_an_arm_with_one_sample(spark, monkeypatch):
    from memloom.jobs import usage

    rows = [("view", 1, 0.75, 5), ("click", 1, 0.25, 5)]
    monkeypatch.setattr(usage, "_arm_means", lambda *_: spark.createDataFrame(rows, "arm string, sample_id long, score double, tokens long"))
    assert [tuple(r) for r in usage.bootstrap_ci(spark, "").collect()] == [("click", 0.5, 0.5)]


def test_rows_of_large_groups_are_numbered_each_once(spark):
    frame = spark.range(400_000).selectExpr("concat('g', id % 4) AS g", "id * 7 AS id", "double(id) AS gap").repartition(6)
    got = bootstrap.numbered(frame, "g").selectExpr("g", "k", "n", "(id / 7 - k * 4 + 4) = int(substring(g, 2)) AS placed").groupBy("g", "n", "placed").agg({"k": "sum", "*": "count"}).collect()
    assert sorted((r.g, r.n, r.placed, r["sum(k)"], r["count(1)"]) for r in got) == [(f"g{i}", 100_000, True, 5_000_050_000, 100_000) for i in range(4)]
