"""Every registered query of the core against its DuckDB twin."""

import pytest

from memloom.jobs import registry
from tests.compare import compare

SF = "/root/testdata/sf0.001"
RUN, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, name):
    compare(spark, RUN[name], SQL[name], SF)


def test_bootstrap_interval_holds_the_gap(spark):
    gaps = {r.arm: r.gap for r in RUN["paired_gap"](spark, SF).collect()}
    for r in RUN["bootstrap_ci"](spark, SF).collect():
        assert r.low <= gaps[r.arm] <= r.high


def test_beam_never_beats_the_exact_best(spark):
    exact = {r.unit: r.logp for r in RUN["exact_decode"](spark, SF).collect()}
    found = RUN["beam_decode"](spark, SF).collect()
    assert len(found) == len(exact)
    assert all(r.score <= exact[r.unit] + 1e-6 for r in found)
    assert sum(abs(r.score - exact[r.unit]) < 1e-6 for r in found) > len(found) / 2
