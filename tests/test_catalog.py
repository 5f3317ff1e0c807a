"""Every catalog query against its DuckDB twin, and the fixed day against its schedule."""

import pytest

from plantlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_twin(spark, duck, compared, name):
    compared(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"), duck("sf0.001"), catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(catalog.DAY_SQL))
def test_twin_of_the_fixed_day(spark, duck, compared, name):
    compared(catalog.DAY_QUERIES[name](spark, ""), duck("sf0.001"), catalog.DAY_SQL[name])


def test_a_planted_difference_is_found(spark):
    rows = [("M1", "A"), ("M1", "A"), ("M2", "B"), (None, "C")]
    left = spark.createDataFrame(rows, "machine string, alarm_code string")
    assert catalog.difference(left, left, "x", "y").count() == 0
    right = spark.createDataFrame([("A", "M1"), ("D", "M9"), ("C", None)], "alarm_code string, machine string")
    assert sorted(map(tuple, catalog.difference(left, right, "x", "y").collect())) == [("M1", "A", "x", 1), ("M2", "B", "x", 1), ("M9", "D", "y", 1)]


def test_fixed_day_meets_its_schedule(spark):
    key = lambda r: (r.machine, r.k)
    got = {key(r): r for r in catalog.DAY_QUERIES["q_demonstration_day"](spark, "").collect()}
    want = {key(r): r for r in catalog.DAY_QUERIES["q_demonstration_truth"](spark, "").collect()}
    assert set(got) == set(want) and len(got) == 9
    for k, w in want.items():
        assert got[k].complete and (got[k].good, got[k].reject) == (w.good, w.reject)
        for name in ("run_seconds", "down_seconds", "idle_seconds", "availability", "performance", "quality", "oee"):
            assert got[k][name] == pytest.approx(w[name], abs=1e-9)
