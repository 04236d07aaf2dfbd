import datetime as dt

import pytest

from vellumic.sources.tables import first_deliveries

D = dt.datetime


@pytest.mark.parametrize("most", [100, 1, 0])
def test_first_deliveries(spark, most):
    rows = [(1, D(2026, 1, 2), "b"), (1, D(2026, 1, 1), "b"), (2, D(2026, 1, 1), "c"), (3, None, "d"), (3, D(2026, 1, 1), "d"), (None, D(2026, 1, 1), None), (None, D(2026, 1, 3), None)]
    df = spark.createDataFrame(rows, "k long, at timestamp, v string")
    got = first_deliveries(df, "k", "at", most).collect()
    assert sorted(((r.k is None, r.k, r.v) for r in got), key=str) == sorted([(False, 1, "b"), (False, 2, "c"), (False, 3, "d"), (True, None, None)], key=str)
    if most == 100:
        assert {r.k: r["at"] for r in got}[1] == D(2026, 1, 1) and {r.k: r["at"] for r in got}[3] is None
    assert first_deliveries(df.limit(0), "k", "at", most).count() == 0


def test_first_deliveries_with_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 6, "a"), (2, 1, "b")], "k int, at int, v string")
    assert sorted(map(tuple, first_deliveries(df, "k", "at").collect())) == [(1, 5, "a"), (2, 1, "b")]
    assert sorted(map(tuple, first_deliveries(df.where("k = 2"), "k", "at").collect())) == [(2, 1, "b")]
