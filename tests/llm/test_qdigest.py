import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumic.llm import qdigest as Q


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**Q.BITS - 1), st.integers(1, 50)), min_size=1, max_size=200), st.integers(2, 400))
def test_compression_keeps_counts_and_its_bound(rows, k):
    gid = np.unique([r[0] for r in rows], return_inverse=True)[1].astype(np.int64)
    cell, cnt = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    g, node, c = Q.compress_nodes(gid, cell + (1 << Q.BITS), cnt, k)
    for i in range(gid.max() + 1):
        n = cnt[gid == i].sum()
        assert c[g == i].sum() == n
        assert (g == i).sum() <= 3 * k + 1 or n // k == 0
        for nd, x in zip(node[g == i], c[g == i]):
            if nd < 1 << Q.BITS:
                assert x <= n // k or nd == 1


def ranks_hold(values, row, probabilities):
    v = np.sort(np.array(values))
    assert row["n"] == len(v)
    for p in probabilities:
        q = row[f"p{p * 100:g}"]
        near = abs(q) * (Q.ALPHA * 1.01) + 2 * Q.TINY
        lo, hi = np.searchsorted(v, q - near, "left"), np.searchsorted(v, q + near, "right")
        slack = row["rank_error"] * len(v) + 1
        assert lo - slack <= math.ceil(p * len(v)) <= hi + slack


def test_days_combine_in_any_order_within_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), float(x)) for d in range(4) for x in np.concatenate([rng.lognormal(0, 2, 3000), np.full(500, 0.25), -rng.random(40)])]
    rows += [(0, float("nan")), (1, None), (2, float("inf")), (3, 0.0)]
    df = spark.createDataFrame(rows, "day int, x double").withColumn("node", F.lit("clash"))
    eps, probs = 0.02, [0.05, 0.5, 0.9]
    days = Q.build(df, ["day"], "x", eps)
    values = [x for _, x in rows if x is not None and not math.isnan(x)]
    whole = Q.quantiles(Q.merge(days.withColumn("g", F.lit(1)), ["g"], eps), ["g"], probs, eps).collect()[0]
    ranks_hold(values, whole, probs)
    pairs = Q.merge(days.withColumn("g", F.expr("day div 2")), ["g"], eps)
    steps = Q.quantiles(Q.merge(pairs.withColumn("all", F.lit(1)), ["all"], eps), ["all"], probs, eps).collect()[0]
    ranks_hold(values, steps, probs)
    assert whole["rank_error"] <= eps and days.groupBy("day").count().agg(F.max("count")).collect()[0][0] <= 3 * Q.factor(eps)


def test_small_groups_are_exact_up_to_the_cell_and_edges_hold(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, 2.0), ("b", None), ("c", float("nan")), ("d", 5.0), ("d", 5.0)], "g string, x double")
    out = {r["g"]: r for r in Q.quantiles(Q.build(df, ["g"], "x"), ["g"], [0, 0.5, 1]).collect()}
    assert set(out) == {None, "d"} and out[None]["n"] == 3 and out[None]["rank_error"] == 0
    assert out[None]["p50"] == pytest.approx(2, rel=Q.ALPHA) and out[None]["p0"] == pytest.approx(1, rel=Q.ALPHA) and out[None]["p100"] == pytest.approx(3, rel=Q.ALPHA)
    assert out["d"]["p50"] == pytest.approx(5, rel=Q.ALPHA)
    assert Q.build(df.limit(0), ["g"], "x").count() == 0
    with pytest.raises(ValueError):
        Q.factor(0)


def test_cells_are_ordered_and_near_their_values(spark):
    xs = sorted([0.0, 1e-7, 1e-6, 2e-6, 0.001, 1.0, 1.0005, 3e9, -4.0, -0.001, 1e300, float("inf"), float("-inf")])
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", Q.cell_of(F.col("x")).alias("c")).withColumn("v", Q.value_of(F.col("c"))).orderBy("x").collect()
    assert [r["c"] for r in rows] == sorted(r["c"] for r in rows) and all(0 <= r["c"] < 2**Q.BITS for r in rows)
    assert all(abs(r["v"] - r["x"]) <= Q.ALPHA * 1.001 * abs(r["x"]) for r in rows if 2 * Q.TINY < abs(r["x"]) < 1e9)
