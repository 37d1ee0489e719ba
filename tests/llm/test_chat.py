"""Snapshot collapse against SQL and brute force."""

import random

from memloom.llm import chat_collapse
from memloom.llm import queries as q
from tests.compare import compare


def test_same_as_sql(spark):
    assert compare(spark, q.op2_snapshot_collapse, q.oracle_sql()["op2_snapshot_collapse"], "/root/testdata/sf0.001") > 0


def test_snapshots_copies_and_odd_turns(spark):
    random.seed(4)
    logs = {i: [(random.choice("ua"), random.choice(["hi", "", None, "ok"])) for _ in range(random.randint(1, 4))] for i in range(200)}
    logs |= {1000 + i: [("u", "the one first turn"), ("a", str(i))] for i in range(300)} | {2000: [("u", "the one first turn")]}
    logs |= {3000: [("u", None)], 3001: [(None, "u")], 3002: [("u", "x" * 500_000)], 3003: [("u", "x" * 500_000), ("a", "y")]}
    rows = [(c, t, *x, "z") for c, turns in logs.items() for t, x in enumerate(turns)] + [(None, 0, "u", "hi", "z")]
    random.shuffle(rows)
    got = chat_collapse.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string"))
    first = {}
    for c in sorted(logs):
        first.setdefault(tuple(logs[c]), c)
    inner = {k[:n] for k in first for n in range(1, len(k))}
    kept = {c: k for k, c in first.items() if k not in inner}
    assert {r.conv_id: r.n_turns for r in got.collect()} == {c: len(k) for c, k in kept.items()}
    assert all(r.chat == "".join(f"<|{role or 'unknown'}|>\n{text or ''}\n<|end|>\n" for role, text in kept[r.conv_id]) for r in got.collect())


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")]
    got = chat_collapse.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.conv_id, r.n_turns) for r in got.collect()] == [(1, 2)]
    assert chat_collapse.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
