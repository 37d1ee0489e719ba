"""Write blocks and streamed memories: replays, other orders of arrival, conflicts, versions, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.jobs import updates as jobs
from memloom.jobs.persistent import write_columns
from memloom.operators import state, updates
from memloom.streaming import memory

ITEMS = "memory long, block string, written timestamp_ntz, item long, m string, src array<string>, entity string, moment long"


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def history():
    random.seed(3)
    rows = []
    for mem in range(12):
        for b in range(random.randint(1, 9)):
            when = at(random.randint(0, 5))
            for item in range(random.randint(1, 3)):
                rows.append((mem, f"b{b % 6}", when, item, random.choice(["x", "y", " ", "z"]), random.choice([None, [], ["s1"], ["s2", "s1"], ["s1", "s2"]]), random.choice([None, "kim", "lee"]), random.choice([None, 1, 2])))
    return rows


def by_hand(rows):
    """Entries by a loop over the writes of each memory in order."""
    out = []
    for mem in sorted({r[0] for r in rows}):
        first = {}
        for r in rows:
            if r[0] == mem:
                first[r[1]] = min(first.get(r[1], r[2]), r[2])
        writes = {(r[2], r[1], r[3]): r for r in rows if r[0] == mem and r[2] == first[r[1]]}
        entries, places = [], {}
        for key in sorted(writes):
            _, block, when, _, m, src, entity, moment = writes[key]
            if not m.strip():
                continue
            src = sorted(src or [])
            k = ("p", *src) if src else ("t", m.strip().lower())
            entry = [m.strip(), src, block, entity, moment, when]
            if k in places:
                entries[places[k]] = entry
            else:
                places[k] = len(entries)
                entries.append(entry)
        for n, e in enumerate(entries):
            rivals = [(x[5], i) for i, x in enumerate(entries) if None not in (e[3], e[4]) and x[3:5] == e[3:5]]
            conflict = len({entries[i][0] for _, i in rivals}) > 1
            out.append((mem, n, *e, conflict, not conflict or (e[5], n) == max(rivals)))
    return out


def flagged(spark, rows):
    out = updates.with_conflicts(updates.updated_entries(spark.createDataFrame(rows, ITEMS).repartition(5)))
    return sorted(tuple(r) for r in out.select("memory", "entry", "m", "src", "version", "entity", "moment", "written", "conflict", "current").collect())


def test_replayed_and_reordered_blocks_leave_one_memory(spark):
    rows = list({(r[0], r[1], r[2], r[3]): r for r in history()}.values())
    want = by_hand(rows)
    assert flagged(spark, rows) == want
    assert {x[-2:] for x in want} == {(True, True), (True, False), (False, True)}
    again = rows + random.sample(rows, len(rows) // 2) * 3
    random.shuffle(again)
    assert flagged(spark, again) == want


def test_a_known_block_at_a_later_time_changes_nothing(spark):
    rows = [(1, "b", at(1), 0, "old", ["s"], None, None), (1, "b", at(2), 0, "new", ["s"], None, None), (1, "b", at(2), 1, "more", ["t"], None, None), (1, "c", at(3), 0, "newest", ["s"], None, None)]
    assert [(r[1], r[2], r[4]) for r in flagged(spark, rows)] == [(0, "newest", "c")]
    got = {r.block: (r.writes, r.replayed) for r in updates.replays(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {"b": (2, 1), "c": (1, 0)}
    assert flagged(spark, []) == []


def test_block_digest_ignores_order_and_copies_of_sources(spark):
    digest = lambda a, ids, c: spark.range(1).select(updates.block_digest(F.lit(a), F.array(*map(F.lit, ids)), F.lit(c)).alias("x")).first().x
    assert digest("Flat", ["2", "1", "2"], "c") == digest("Flat", ["1", "2"], "c")
    assert len({digest("Flat", ["1"], "c"), digest("Graph", ["1"], "c"), digest("Flat", ["2"], "c"), digest("Flat", ["1"], "d"), digest("Flat", ["1"], None)}) == 5


@pytest.fixture
def turns(tmp_path):
    random.seed(5)
    rows = [(c, t, random.choice(["user", "bot"]), random.choice(["a", "b  c", "", None, "d"])) for c in range(30) for t in range(random.randint(1, 12))]
    random.shuffle(rows)
    return rows, str(tmp_path)


def test_state_after_every_batch_and_after_a_restart(spark, turns):
    rows, folder = turns
    parts = [rows[:60], rows[60:100], rows[100:]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, memory.TURNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        # each run starts a new query on the same checkpoint
        memory.run(write_columns(memory.read_turns(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/check").awaitTermination()
        there = [x for p in parts[: n + 1] for x in p]
        writes = write_columns(spark.createDataFrame(there, memory.TURNS))
        now = memory.rows_at(spark, f"{folder}/out")
        same(memory.entries_of(now), state.entries_after(writes))
        same(memory.sources_of(now), state.sources_after(writes))
    # earlier versions can still be read
    writes = write_columns(spark.createDataFrame(parts[0], memory.TURNS))
    same(memory.entries_of(memory.rows_at(spark, f"{folder}/out", 0)), state.entries_after(writes))


def same(got, want):
    columns = want.columns
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(got) == rows(want)


def test_rows_that_arrive_again_change_nothing(spark, turns):
    rows, folder = turns
    for _ in range(2):
        spark.createDataFrame(rows, memory.TURNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        memory.run(write_columns(memory.read_turns(spark, f"{folder}/in", 1)), f"{folder}/out", f"{folder}/check").awaitTermination()
    writes = write_columns(spark.createDataFrame(rows, memory.TURNS))
    same(memory.entries_of(memory.rows_at(spark, f"{folder}/out")), state.entries_after(writes))


def test_the_log_has_each_item_once(spark, turns):
    rows, folder = turns
    rows = [r for r in rows if r[3]]
    for part in (rows, rows[::2], rows):
        spark.createDataFrame(part, memory.TURNS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        memory.run_log(jobs.block_items(memory.read_turns(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/check").awaitTermination()
    log = spark.read.parquet(f"{folder}/out")
    assert log.count() == len(rows)
    once = jobs.block_items(spark.createDataFrame(rows, memory.TURNS))
    same(updates.with_conflicts(updates.updated_entries(log)), updates.with_conflicts(updates.updated_entries(once)))
