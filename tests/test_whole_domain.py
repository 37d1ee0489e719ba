"""Queries on all candidate sets of all units: units of any number of sources, of costly inputs, and sets dearer than the full one."""

import os
from itertools import product

import pytest

from memloom.jobs import registry
from tests.compare import TABLES, compare

RUN, SQL = registry.queries(), registry.oracle_sql()
GIVEN = "/root/testdata/sf0.001"
#: Turns of each conversation, and words of its turns.
UNITS = {4: (1, 3), 2: (2, 4), 3: (3, 5), 5: (8, 300), 8: (63, 2), 13: (64, 2), 21: (65, 1), 34: (70, 1), 55: (130, 30)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("wide")
    for name in TABLES:
        os.symlink(f"{GIVEN}/{name}.parquet", at / f"{name}.parquet")
    rows = [(unit, turn, "user", " ".join(["word"] * (words + turn % 3))) for unit, (n, words) in UNITS.items() for turn in range(n)]
    os.remove(at / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(at / "conversations.parquet"))
    return str(at)


def sets_of(unit: int) -> set[tuple[int, ...]]:
    """The sets of a unit by plain loops."""
    n = UNITS[unit][0]
    two, three, every = min(n, 2), 3 if n > 2 else 1, set(range(1, n + 1))
    first, second = [{1}, {two}], [{two, n}, {1, three}]
    out = {tuple(every)}
    session = {i: (i - 1) // 3 if (i - 1) % 5 != 4 else None for i in every}
    for a, b in product(first, second):
        base = a | b
        far = lambda i: min((abs(i - j) for j in base if session[i] is not None and session[j] == session[i]), default=10**9)  # noqa: B023, E731
        extras = sorted(every - base, key=lambda i: (far(i), -((i - 1) * 7 % 5), i))[:8]
        out |= {tuple(sorted(base | {x for k, x in enumerate(extras) if pick >> k & 1})) for pick in range(1 << len(extras))}
        out.add(tuple(sorted(base | (every - set().union(*first, *second)))))
    return out


def named(ids) -> tuple[int, str]:
    mask = sum(1 << (i - 1) for i in ids if i <= 64)
    return mask - (1 << 64) if mask >> 63 else mask, ",".join(str(i) for i in ids if i > 64)


def test_sets_are_those_of_plain_loops(spark, folder):
    got = RUN["form_coverage"](spark, folder).collect()
    assert len(got) == len({(r.unit, r.mask, r.more) for r in got})
    for unit in UNITS:
        assert {(r.mask, r.more) for r in got if r.unit == unit} == {named(x) for x in sets_of(unit)}
    assert all(r.covers for r in got)


def test_budgets_reach_sets_of_wide_and_costly_units(spark, folder):
    cost = lambda unit, i: -(-(UNITS[unit][1] + (i - 1) % 3) * 13 // 10)
    got = {(r.unit, r.mask, r.more, r.budget) for r in RUN["prefix_reachable"](spark, folder).collect()}
    want = set()
    for unit in UNITS:
        for ids in sets_of(unit):
            prefixes = [sum(cost(unit, i) for i in ids[: k + 1]) + (60 if k == 0 else 0) for k in range(len(ids))]
            want |= {(unit, *named(ids), b) for b in (128, 256, 512) if max(prefixes) <= b}
    assert got == want and {55, 34, 21} <= {x[0] for x in got}


@pytest.mark.parametrize("name", ["prefix_reachable", "cost_bounds", "budget_archive", "beneficial_switch", "form_coverage", "archive_jaccard", "evaluation_order", "conservative_cost", "architecture_gain", "train_rows", "screening_gates", "screening_savings", "first_choice"])
def test_same_rows_as_duckdb_and_no_unit_lost(spark, folder, name):
    assert compare(spark, RUN[name], SQL[name], folder)
    units = {r.unit for r in RUN[name](spark, folder).select("unit").distinct().collect()}
    assert {4, 2, 3, 8, 13, 21, 34, 55} <= units  # unit 5: no set within a budget
