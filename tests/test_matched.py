from pyspark.sql import functions as F

from vellumic.functions.geometry import box
from vellumic.operators import align as A
from vellumic.plans import evidence as P
from vellumic.plans import fixtures as V


def put(spark, rows, name):
    d = spark.createDataFrame([(1, p, i, *map(float, b), t) for p, i, b, t in rows], f"doc long, page int, {name} long, x double, y double, w double, h double, text string")
    return d.withColumn("box", box(*[F.col(c) for c in "xywh"])).drop(*"xywh")


def test_one_block_for_two_regions(spark):
    """Two regions fit the one block of page 0: one gets it. On page 1 a block holds two small regions that cost too much."""
    r = put(spark, [(0, 0, (10, 10, 20, 5), "a"), (0, 1, (10, 11, 20, 5), "a"), (1, 2, (40, 5, 4, 4), "b"), (1, 3, (45, 6, 4, 4), "c"), (2, 4, (0, 0, 5, 5), "d")], "region")
    b = put(spark, [(0, 0, (10, 10, 20, 5), "a"), (1, 1, (0, 0, 100, 300), "zzz zzz zzz")], "block").withColumn("reading_order", F.lit(100))
    got = {(x.region, x.block, x.status, round(x.iou, 4)) for x in A.matched(r, b).collect()}
    assert got == {(0, 0, "one_to_one", 1.0), (2, 1, "one_to_many", 0.0005), (3, 1, "one_to_many", 0.0005)}
    assert A.matched(r.limit(0), b).count() == 0


def test_summary_counts_the_alignment(spark, sf):
    pairs = A.align(V.regions(spark, sf), V.blocks(spark, sf)).where("region IS NOT NULL").collect()
    want = {(x.doc, x.region): x.block for x in pairs}
    evidence = P.region_evidence(spark, sf).collect()
    assert {(x.doc, x.region): x.block for x in evidence} == want
    single = [(x.doc, x.page, x.block) for x in pairs if x.status == "one_to_one"]
    assert len(single) == len(set(single))
    counted = {}
    for (doc, _), block in want.items():
        counted[doc] = counted.get(doc, 0) + (block is not None)
    summary = {x.doc: x for x in P.fusion_summary(spark, sf).collect()}
    assert {k: x.matched for k, x in summary.items()} == counted


def test_unfit_tells_both_sides_in_one_pass(spark, sf):
    """Page 0: a pair and a block too far off; page 1: regions only; page 2: a block only; a null page: nothing fits."""
    r = put(spark, [(0, 0, (10, 10, 20, 5), "a"), (1, 1, (40, 5, 4, 4), "b"), (1, 2, (45, 6, 4, 4), "c"), (None, 3, (10, 10, 20, 5), "a")], "region")
    b = put(spark, [(0, 0, (10, 10, 20, 5), "a"), (0, 1, (90, 90, 5, 5), "z"), (2, 2, (0, 0, 5, 5), "d"), (None, 3, (10, 10, 20, 5), "a")], "block").withColumn("reading_order", F.lit(1))
    want = {(0, 1, "block"), (1, 1, "region"), (1, 2, "region"), (2, 2, "block"), (None, 3, "region"), (None, 3, "block")}
    rows = [(x.page, x.id, x.side) for x in A.unfit(r, b).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert {x.side for x in A.unfit(r.limit(0), b).collect()} == {"block"} and {x.side for x in A.unfit(r, b.limit(0)).collect()} == {"region"}
    plan = P.gated_unmatched(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 2  # regions and blocks are made once each, their pairs once
