"""Exact costs, caps and evaluation in rounds against loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import compilation, domain, policy, pricing


def ids(mask):
    return [i + 1 for i in range(64) if mask >> i & 1]


def signed(mask):
    return mask - (1 << 64) if mask >= 1 << 63 else mask


SOURCES = "unit long, n long, sources array<struct<id:int,source_id:string,session:string,speaker:string,time:string,position:long,source_offset:int,text:string>>"


def units(sizes):
    random.seed(2)
    return [(u, n, [(i, f"{u}:{i}", random.choice([None, "s"]), "me", None, i, None, random.choice([None, "", 'a "b"\n', "é" * i, "word " * (i % 5)])) for i in range(1, n + 1)]) for u, n in sizes]


def prompt(unit, architecture, mask):
    took = [s for s in unit[2] if mask >> (s[0] - 1) & 1]
    names = [s[0] for s in took]
    fields = ["id", "source_id", "session", "speaker", "time", "position", "source_offset", "text"]
    value = {
        "schema": "memory-1", "architecture": architecture, "architecture_contract": pricing.CONTRACTS[architecture], "write_stage": True,
        "structure": {"architecture": architecture, "nodes": names, "groups": [names] if architecture == "Flat" else [], "edges": [list(x) for x in zip(names, names[1:])] if architecture == "Chain" else []},
        "system": pricing.builder.SYSTEM, "sources": [dict(zip(fields, s)) | {"text": s[7] or ""} for s in took],
        "output": {"type": "array", "item": {"m": "string", "src": "integer[]"}, "max_items": pricing.builder.MAX_ITEMS},
    }
    return pricing.INSTRUCTION.replace("{architecture}", architecture) + "\n" + json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def cost(unit, architecture, mask):
    return -(-len(prompt(unit, architecture, mask).encode()) // 4) if mask else 0


def test_costs_of_whole_inputs_and_of_their_prefixes(spark):
    rows = units([(1, 5), (2, 64), (3, 1)])
    sets = [(u[0], a, u[1], m) for u in rows for a in pricing.CONTRACTS for m in {0, 1, (1 << u[1]) - 1, 1 << (u[1] - 1), random.getrandbits(u[1])}]
    frame = spark.createDataFrame([(u, a, n, signed(m)) for u, a, n, m in sets], "unit long, architecture string, n long, mask long")
    got, priced = pricing.with_costs(frame, spark.createDataFrame(rows, SOURCES), pricing.by_bytes)
    by_unit = {u[0]: u for u in rows}
    want = {(u, a, signed(m)): (cost(by_unit[u], a, m), max(cost(by_unit[u], a, sum(1 << (i - 1) for i in ids(m)[:k])) for k in range(len(ids(m)) + 1))) for u, a, _, m in sets}
    assert {(r.unit, r.architecture, r.mask): (r.cost, r.reach) for r in got.collect()} == want
    # what is known isn't counted again
    def refuse(rows):
        assert rows.isEmpty()
        return rows.select("unit", "architecture", "mask", F.lit(0).cast("long").alias("cost"))

    again = pricing.price(frame, spark.createDataFrame(rows, SOURCES), refuse, priced)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, priced.collect()))


def test_a_tokenizer_counts_the_same_inputs(spark):
    tokenizers, vocabulary = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_50k.json")
    rows = units([(1, 4)])
    frame = spark.createDataFrame([(1, a, 4, m) for a in pricing.CONTRACTS for m in range(16)], "unit long, architecture string, n long, mask long")
    got = pricing.price(frame, spark.createDataFrame(rows, SOURCES), pricing.by_tokenizer(open(path, encoding="utf-8").read()))
    tokenizer = tokenizers.Tokenizer.from_file(path)
    want = {(a, m): len(tokenizer.encode(prompt(rows[0], a, m), add_special_tokens=False).ids) if m else 0 for a in pricing.CONTRACTS for m in range(16)}
    assert {(r.architecture, r.mask): r.cost for r in got.collect()} == want


def test_parts_cost_what_whole_inputs_do_and_are_counted_once(spark):
    vocabulary = pytest.importorskip("public_tokenizers")
    definition = open(vocabulary.path("byte_bpe_50k.json"), encoding="utf-8").read()
    count = pricing.by_tokenizer(definition)
    assert pricing.adds_up(definition) and not pricing.adds_up(json.dumps(json.loads(definition) | {"normalizer": {"type": "NFC"}}))
    odd = ["", "<|endoftext|>", "it's '", ' "}', "}", "null", "\\", "\x0b \x1f", "5", " id", "ß漢字 12", "<|endoftext|>\n"]
    rows = units([(1, 5), (2, 64), (3, 1), (4, 3)]) + [(5, len(odd), [(i, f"5:{i}", None, None, None, i, None, t) for i, t in enumerate(odd, 1)])]
    rows.append((6, 2, [(1, "6:1", None, "me", "null", 1, None, "a"), (2, "6:2", None, "me", "12", 2, None, "b")]))  # with a time
    rows.append((7, 3, [(1, "7:1", None, "me", None, 1, None, "a"), (3, "7:3", None, "me", None, 3, None, "b"), (3, "7:3", None, "me", None, 3, None, "c")]))  # ids repeat, and one is missing
    sets = {(u, a, n, m) for u, n, _ in rows for a in pricing.CONTRACTS for m in [0, (1 << n) - 1, *(1 << i for i in range(n)), *(random.getrandbits(n) for _ in range(6))]}
    frame = spark.createDataFrame([(u, a, n, signed(m)) for u, a, n, m in sets], "unit long, architecture string, n long, mask long")
    sources = spark.createDataFrame(rows, SOURCES)
    want = sorted(map(tuple, pricing.price(frame, sources, count).collect()))
    assert sorted(map(tuple, pricing.price(frame, sources, count, parts=True).collect())) == want and len(want) == len(sets)
    # forty units of the same shapes: each source and each shape is written once, not each set
    many = units([(u, 6) for u in range(40)])
    frame = spark.createDataFrame([(u, a, 6, m) for u in range(40) for a in pricing.CONTRACTS for m in range(64)], "unit long, architecture string, n long, mask long")
    counted = []

    def noted(priced):
        counted.append(priced.count())
        return count(priced)

    pricing.price(frame, spark.createDataFrame(many, SOURCES), noted, parts=True)
    assert sum(counted) == 2 * 63 + 40 * 6 + 64  # shapes, sources, stand-ins


def test_cap_and_status(spark):
    rows = [(1, 2, 0, 0), (1, 2, 1, 60), (1, 2, 3, 50), (2, 1, 1, 101), (2, 1, 0, 0), (3, 2, 3, 100), (3, 2, 2, 100)]
    frame = spark.createDataFrame(rows, "unit long, n long, mask long, cost long")
    assert sorted((r.unit, r.mask) for r in pricing.capped(frame, 100, "unit").collect()) == [(1, 0), (1, 3), (3, 2), (3, 3)]
    status = domain.unit_status(spark.createDataFrame([(1, 64), (2, 65), (3, 2)], "unit long, n long"), spark.createDataFrame([(1, 9), (2, 9), (3, 10)], "unit long, full_cost long"), 9)
    assert {r.unit: r.status for r in status.collect()} == {1: "ok", 2: "too_many_sources", 3: "over_input_limit"}


def loop(sets, status, limit):
    """One unit after the other, as a program would: the full set, then by cost, until nothing cheaper can pass."""
    records = {}
    for unit in sorted({s[0] for s in sets}):
        own = [s for s in sets if s[0] == unit]
        full = (1 << own[0][1]) - 1
        order = sorted((s for s in own if s[4] or s[2] == full), key=lambda s: (s[2] != full, s[3], ids(s[2])))
        best = None
        for place, (_, _, mask, price, reached) in enumerate(order, 1):
            if limit and place > limit or best is not None and price >= best:
                break
            records[unit, mask] = (place, status[unit, mask])
            if status[unit, mask] == "PASS" and reached and (best is None or price < best):
                best = price
    return records


@pytest.mark.parametrize("limit", [None, 3])
def test_rounds_do_what_a_loop_does(spark, limit):
    random.seed(4)
    sets, status = [], {}
    for unit in range(25):
        n = random.randint(1, 4)
        for mask in range(1 << n):
            if mask == (1 << n) - 1 or random.random() < 0.8:
                sets.append((unit, n, mask, random.randint(1, 6) * 10, random.random() < 0.8))
                status[unit, mask] = random.choice(["PASS", "FAIL", "FAIL", "FAIL", "UNKNOWN"])
    frame = spark.createDataFrame(sets, "unit long, n long, mask long, cost long, reached boolean")
    known = spark.createDataFrame([(*k, v) for k, v in status.items()], "unit long, mask long, status string")
    asked = []

    def evaluate(rows):
        asked.extend((r.unit, r.mask) for r in rows.collect())
        return rows.join(known, ["unit", "mask"])

    records = compilation.compile_domain(frame, evaluate, "unit", limit=limit)
    want = loop(sets, status, limit)
    assert {(r.unit, r.mask): (r.place, r.status) for r in records.collect()} == want
    assert len(asked) == len(set(asked)) == len(want)
    for r in compilation.certificate(frame, records, "unit").collect():
        seen = {s[2]: (s[3], want.get((r.unit, s[2]), (0, None))[1]) for s in sets if s[0] == r.unit and s[4]}
        upper = min((c for c, x in seen.values() if x == "PASS"), default=None)
        lower = min((c for c, x in seen.values() if x != "FAIL"), default=None)
        assert (r.lower, r.upper, r.closed, r.unseen) == (lower, upper, upper is not None and upper == lower, sum(x is None for _, x in seen.values()))
        assert r.evaluations == sum(u == r.unit for u, _ in want)
    # what an earlier run evaluated is kept
    half = records.where("place = 1")
    asked.clear()
    again = compilation.compile_domain(frame, evaluate, "unit", limit=limit, records=half)
    assert {(r.unit, r.mask): (r.place, r.status) for r in again.collect()} == want
    assert len(asked) == len(want) - half.count()


def test_unknown_statuses_are_refused(spark):
    frame = spark.createDataFrame([(1, 1, 1, 5, True)], "unit long, n long, mask long, cost long, reached boolean")
    with pytest.raises(Exception, match="unknown status"):
        compilation.compile_domain(frame, lambda rows: rows.withColumn("status", F.lit("MAYBE")), "unit").collect()


def test_sets_grow_under_any_cost(spark):
    random.seed(7)
    n, budget = 7, 50
    price = {m: random.randint(0, 80) for m in range(1, 1 << n)}
    table = spark.createDataFrame(list(price.items()), "mask long, cost long")
    got = policy.prefixes(spark.createDataFrame([(1, n)], "unit long, n long"), budget, lambda rows: rows.drop("cost").join(table, "mask"))
    ok = {m for m in range(1 << n) if all(price.get(sum(1 << (i - 1) for i in ids(m)[:k]), 0) <= budget for k in range(len(ids(m)) + 1))}
    assert {r.mask: r.cost for r in got.collect()} == {m: price.get(m, 0) for m in ok}
    assert all((r["last"], r.size) == ((ids(r.mask) or [0])[-1], len(ids(r.mask))) for r in got.collect())


def test_training_rows_up_to_a_limit_of_usable_ones(spark):
    rows = [(1, 16, 0, 0), (2, 16, 2, 0), (3, 16, 1, 0), (4, 16, 2, 1), (1, 8, 3, 0)]
    frame = spark.createDataFrame(rows, "unit long, budget long, labels long, unverified long").withColumn("usable", F.expr("labels > 0 AND unverified = 0"))
    taken = lambda limit, df=frame: sorted((r.budget, r.unit) for r in domain.train_selection(df, ["budget", "unit"], limit).collect())
    assert taken(1) == [(8, 1)] and taken(3) == [(8, 1), (16, 2), (16, 3)]
    for limit in (4, None):  # the row without audits would have been reached
        with pytest.raises(Exception, match="lack verified audits"):
            taken(limit)
    good = frame.where("unverified = 0")
    assert taken(None, good) == taken(9, good) == [(8, 1), (16, 2), (16, 3)]
    assert taken(2, frame.where("unit = 1 AND budget = 16")) == []
