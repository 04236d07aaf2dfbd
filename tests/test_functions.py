import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellumic.functions import extract as P
from vellumic.functions import geometry as G
from vellumic.functions import text as X
from vellumic.functions.edit import placed, script, word_distance, word_script
from vellumic.operators.align import greedy, hungarian


def box(*v):
    return G.box(*[F.lit(float(x)) for x in v])


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def test_boxes(spark):
    a, b, c = box(10, 10, 20, 20), box(0, 0, 20, 20), box(10, 0, 20, 20)
    r = one(spark, G.iou(a, a), G.iou(box(0, 0, 10, 10), box(20, 20, 10, 10)), G.iou(b, c), G.iou(box(0, 0, 0, 0), a), G.contains_center(box(0, 0, 100, 100), box(40, 40, 20, 20)), G.contains_center(box(0, 0, 30, 30), box(40, 40, 20, 20)))
    assert list(r) == [1.0, 0.0, pytest.approx(200 / 600), 0.0, True, False]
    r = one(spark, *[G.is_valid(box(*v)) for v in ((10, 20, 30, 40), (60, 0, 50, 10), (-1, 0, 5, 5), (0, 0, 0, 5))])
    assert list(r) == [True, False, False, False]
    poly = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((100, 200), (400, 200), (400, 300), (100, 300))])
    corners = F.array(*[F.lit(float(v)) for v in (100, 200, 500, 600)])
    r = one(spark, G.from_polygon(poly, F.lit(1000), F.lit(1000)), G.from_corners(corners, F.lit(1000), F.lit(1000)), G.from_polygon(F.slice(poly, 1, 2), F.lit(9), F.lit(9)), G.crop_pixels(box(99.9, 0, 5, 0.01), F.lit(1000), F.lit(500)))
    assert [tuple(x) for x in r] == [(10, 20, 30, 10), (10, 20, 40, 40), (5, 5, 90, 10), (950, 0, 50, 1)]
    assert one(spark, G.iou(F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"), a))[0] == 0.0


def test_text(spark):
    r = one(spark, X.normalize(F.lit("  Hello \t\n World  ")), X.tokens(F.lit("  ")), *[X.is_critical(F.lit(w)) for w in ("4.8", "39", "12/10/2026", "4.8m", "50kg", "the", "wall", None)])
    assert list(r) == ["hello world", [], True, True, True, True, True, False, False, False]
    r = one(spark, X.iso_date(F.lit("03-04-2024")), X.iso_date(F.lit("3 April")), X.human_size(F.lit(2048)), X.human_size(F.lit(3 * 1024 * 1024)), X.percent(F.lit(None).cast("double")), X.replace_line(F.lit("a\nb\na"), F.lit("b"), F.lit("c")), X.replace_line(F.lit("a\nb\na"), F.lit("a"), F.lit("c")))
    assert list(r) == ["2024-04-03", None, "2.0 KB", "3.0 MB", "Not provided", "a\nc\na", None]
    r = one(spark, *[X.sanitize_filename(F.lit(n)) for n in ("../../etc/pass wd", "a\\b\\c?.pdf", "", None, "..")])
    assert list(r) == ["pass wd", "c_.pdf", "document", "document", "document"]


def cheapest(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_script_is_a_cheapest_one_and_rebuilds_its_target(a, b):
    s = script(a, b)
    assert sum(x[0] != "MATCH" for x in s) == cheapest(a, b)
    words, added = placed(a, b)
    want: list = [None] * len(a)
    for op, at, _, _, word in s:
        if op != "INSERTION":
            want[at] = word
    assert words == want and added == [x[4] for x in s if x[0] == "INSERTION"]
    assert [x[4] for x in s if x[0] != "DELETION"] == b and [x[3] for x in s if x[0] != "INSERTION"] == a


def test_edit_functions_take_nulls(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (None, ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(word_distance(F.col("a"), F.col("b"))).collect()] == [1, None, 0]
    assert [r[0] and len(r[0]) for r in df.select(word_script("a", "b")).collect()] == [2, None, []]


def brute(cost):
    from itertools import permutations

    n, m = cost.shape
    if n > m:
        return brute(cost.T)
    return min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = np.array([[rng.choice([0.1, 0.5, 999.0, rng.random()]) for _ in range(m)] for _ in range(n)])
        got = hungarian(cost)
        assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
        assert sum(cost[i, j] for i, j in got) == pytest.approx(brute(cost))
    assert greedy([(0, 0, 0.1), (0, 1, 0.9), (1, 0, 0.8), (1, 1, 0.2)]) == [(0, 0), (1, 1)]


def test_extraction(spark):
    m = one(spark, P.key_values(F.lit("A b: 1\n\nnothing\nC : x: y\na B: 2")))[0]
    assert m == {"a b": "2", "c": "x: y"}
    r = one(spark, *[P.lab_value(F.lit(v)) for v in ("4 - 10.5", " 3.2 ", "trace", None)])
    assert [tuple(x)[:3] for x in r[:2]] == [("range", 4.0, 10.5), ("number", 3.2, 3.2)] and r[2]["text"] == "trace"
    html = "<p>x<table><tr><th colspan=500>A</th><th>B<script>no</script></th></tr><tr><td> 1 &amp; 2 </td></tr></table><table><tr><td>other</td></tr></table>"
    rows = P.table_rows(html)
    assert [[c["text"] for c in r] for r in rows] == [["A", "B"], ["1 & 2"]] and rows[0][0]["colspan"] == 100 and rows[0][0]["header"]
    assert P.table_rows(None) is None and P.table_rows("") == [] and P.table_rows("no table") == []
    cells = spark.createDataFrame([("d", 1, "Blood", None, None, None), ("d", 2, "Iron", "3", "mg", "1 - 4"), ("d", 3, "Sugar", "trace", "", "")], "doc string, ord int, name string, value string, unit string, range string")
    report = P.lab_report(P.lab_rows(cells, ["doc"], "ord"), ["doc"]).collect()[0]
    assert [(x.section, x.name) for x in report.results] == [("Blood", "Iron"), ("Blood", "Sugar")] and report.warnings == []
