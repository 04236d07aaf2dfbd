import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumic.config import SelectConfig
from vellumic.operators import align as A
from vellumic.operators import evidence as E
from vellumic.operators import ingest, metrics, review
from vellumic.functions.edit import word_distance
from vellumic.functions.geometry import box


SELECT = SelectConfig(reliability=("m1", "m2", "m3"), family=("m2", "m3"))


def rate(spark, texts, confs=None, **extra):
    models = ["m1", "m2", "m3"]
    rows = [(1, i, models[i], t, (confs or [0.9] * 9)[i]) for i, t in enumerate(texts)]
    df = E.collect(spark.createDataFrame(rows, "region long, ord int, model string, text string, conf double"), ["region"])
    for k, v in extra.items():
        df = df.withColumn(k, F.lit(v))
    df = E.detect(E.lattice(df))
    return {s: E.propose(df, SELECT, s).collect()[0] for s in ("best_individual", "unweighted_rover", "evidence_aware")}


def kinds(r):
    return [d.type for d in r["evidence_aware"].disagreements]


def spans(r, kind):
    return [d.span for d in r["evidence_aware"].disagreements if d.type == kind]


def test_one_reading(spark):
    r = rate(spark, ["fig oil salt"])["evidence_aware"]
    assert r.overall == "SINGLE_MODEL_ONLY" and len(r.positions) == 3 and r.requires_review and r.auto_proposable and r.proposed_text == "fig oil salt"
    assert [d.type for d in r.disagreements] == ["INSUFFICIENT_EVIDENCE"]


def test_agreement_keeps_the_raw_text(spark):
    r = rate(spark, ["Green Lamp", "green  lamp"])["evidence_aware"]
    assert r.overall == "FULL_AGREEMENT" and r.proposed_text == "Green Lamp" and r.auto_proposable and not r.requires_review


def test_conflicts(spark):
    r = rate(spark, ["the beam is 7.5 long", "the beam is 7.6 long"])
    assert "NUMERIC_CONFLICT" in kinds(r) and not r["evidence_aware"].auto_proposable and "CRITICAL_NUMERIC" in r["evidence_aware"].indicators
    assert spans(rate(spark, ["due 03/04/1931", "due 03/05/1931", "due soon"]), "DATE_CONFLICT") == ["03/04/1931 vs 03/05/1931 vs (none)"]
    assert spans(rate(spark, ["take 20mg", "take 20ml", "take 20mg"]), "UNIT_CONFLICT") == ["20mg vs 20ml vs 20mg"]
    # the first three in the order of the readings, repeats included
    assert spans(rate(spark, ["71 sacks", "11 sacks"]), "NUMERIC_CONFLICT") == ["71 vs 11"]
    assert spans(rate(spark, ["b 9", "a 4", "c 9"]), "NUMERIC_CONFLICT") == ["9 vs 4 vs 9"]


def test_votes(spark):
    r = rate(spark, ["red kettle", "red kettle", "red cattle"])
    assert r["evidence_aware"].overall == "MINORITY_DISAGREEMENT" and r["unweighted_rover"].proposed_text == "red kettle"
    assert [p.conflict for p in r["evidence_aware"].positions] == [None, "cattle vs kettle"]
    r = rate(spark, ["north x", "south x", "south x"])  # two of one family against an independent reading
    assert r["unweighted_rover"].proposed_text == "north x"
    r = rate(spark, ["dry wood", "dry old elm wood"])
    assert r["evidence_aware"].overall == "EXTRA_TEXT" and [p.agreement for p in r["evidence_aware"].positions] == ["FULL_AGREEMENT"] * 2 + ["EXTRA_TEXT"] * 2
    assert [p.conflict for p in r["evidence_aware"].positions][2:] == ["inserted: old", "inserted: elm"]
    r = rate(spark, ["a long road", "a road", "a long road"])
    assert spans(r, "MISSING_TEXT") == ["long long"] and r["evidence_aware"].proposed_text is None and r["best_individual"].proposed_text == "a long road"  # a word for each model that has it


def test_scripts_of_all_pairs(spark):
    df = E.collect(spark.createDataFrame([(1, i, f"m{i}", t, 0.5) for i, t in enumerate(["a b c", "a c", "x a c"])], "region long, ord int, model string, text string, conf double"), ["region"])
    got = {(s.a, s.b): [x.op for x in s.steps] for s in E.scripts(df).collect()[0].scripts}
    assert got == {(0, 1): ["MATCH", "DELETION", "MATCH"], (0, 2): ["SUBSTITUTION", "SUBSTITUTION", "MATCH"], (1, 2): ["INSERTION", "MATCH", "MATCH"]}


def test_odd_readings(spark):
    rows = [(1, 0, "m1", "one", 0.9), (1, 1, "m2", "two", 0.9), (1, 2, "m1", "three", 0.9), (2, 0, "m1", None, None), (None, 0, None, "t", None)]
    df = E.collect(spark.createDataFrame(rows, "region long, ord int, model string, text string, conf double"), ["region"])
    got = {r.region: [h.text for h in r.hyps] for r in df.collect()}
    assert got == {1: ["two", "three"], 2: [None], None: ["t"]}
    assert E.propose(E.detect(E.lattice(df)), SELECT).count() == 3 and E.lattice(df.limit(0)).count() == 0
    none = df.limit(1).withColumn("hyps", F.slice("hyps", 1, 0))
    r = E.propose(E.detect(E.lattice(none)), SELECT).collect()[0]
    assert r.positions == [] and r.proposed_text is None and r.requires_review and not r.auto_proposable
    with pytest.warns(UserWarning):
        assert E.propose(E.detect(E.lattice(df)), SELECT, "no such strategy").count() == 3


def test_other_rules(spark):
    assert "MODEL_UNAVAILABLE" in kinds(rate(spark, ["words", " "])) and "LOW_RAW_CONFIDENCE" in kinds(rate(spark, ["a", "a"], [0.2, None]))
    assert "GEOMETRY_MISMATCH" in kinds(rate(spark, ["a", "a"], iou=0.01)) and "GEOMETRY_MISMATCH" not in kinds(rate(spark, ["a", "a"], iou=0.8))
    assert "UNSUPPORTED_COMPLETION_SUSPECTED" in kinds(rate(spark, ["a b", "a b c d e f"])) and "UNSUPPORTED_COMPLETION_SUSPECTED" not in kinds(rate(spark, ["a b c d e f", "a b"]))
    assert "READING_ORDER_CONFLICT" in kinds(rate(spark, ["a", "a"], region_order=1, block_order=9))
    r = rate(spark, [None, "text here"])
    assert r["best_individual"].proposed_text == "text here"


@pytest.mark.parametrize("recovered,existing,want", [("oak door", ["Oak Door"], "NEUTRAL"), ("An", ["a rather long line of words"], "REGRESSED"), ("oak door", ["oak floor"], "NEUTRAL"), ("7 kegs", ["7 kegs", "1 kegs"], "IMPROVED"), ("x", [], "NEUTRAL"), ("", ["a"], "NEUTRAL"), (None, ["a"], "NEUTRAL")])
def test_recovery(spark, recovered, existing, want):
    df = spark.createDataFrame([(recovered, existing)], "r string, e array<string>")
    assert df.select(E.recovery_outcome(F.col("r"), F.col("e"))).collect()[0][0] == want


def page(rows, name):
    return [(1, p, i, x, y, w, h, t) for p, i, x, y, w, h, t in rows]


def test_alignment(spark):
    cols = "doc long, page int, {} long, x double, y double, w double, h double, text string"
    r = spark.createDataFrame(page([(0, 0, 10.0, 10.0, 20.0, 5.0, "a"), (0, 1, 10.0, 30.0, 20.0, 5.0, "b"), (1, 2, 10.0, 10.0, 20.0, 5.0, "a"), (0, 3, 12.0, 70.0, 2.0, 2.0, "c"), (2, 9, 1.0, 1.0, 5.0, 5.0, None)], "region"), cols.format("region"))
    b = spark.createDataFrame(page([(0, 0, 10.0, 10.0, 20.0, 5.0, "a"), (0, 1, 10.0, 30.5, 20.0, 5.0, "b"), (1, 2, 10.0, 10.0, 20.0, 5.0, "a"), (0, 4, 0.0, 60.0, 90.0, 30.0, "zzz zzz zzz"), (3, 7, 1.0, 1.0, 5.0, 5.0, "q")], "block"), cols.format("block")).withColumn("reading_order", F.lit(None).cast("int"))
    put = lambda d: d.withColumn("box", box(*[F.col(c) for c in "xywh"])).drop(*"xywh")
    got = {(x.region, x.block, x.status) for x in A.align(put(r), put(b)).collect()}
    assert {(0, 0, "one_to_one"), (1, 1, "one_to_one"), (2, 2, "one_to_one"), (9, None, "unmatched_region"), (None, 7, "unmatched_block")} <= got
    assert (3, 4, "one_to_many") in got or (3, 4, "one_to_one") in got
    assert len(got) == 6
    assert {x.region: x.iou for x in A.align(put(r), put(b)).collect() if x.block is not None and x.region in (1, 3)} == {1: 0.8182, 3: 0.0015}
    assert A.align(put(r).limit(0), put(b)).count() == 5


def test_metrics(spark):
    df = spark.createDataFrame([("a b c", "a x c", "s"), ("12 d", "", "s"), (None, None, "t")], "ground_truth string, prediction string, style string")
    rows = {r["style"]: r for r in metrics.summary(metrics.scored(df), ["style"]).collect()}
    assert rows["s"].cer == pytest.approx(5 / 9, abs=1e-6) and rows["s"].wer == pytest.approx(3 / 5) and rows["s"].numeric_error_rate == 1.0 and rows["t"].cer == 0.0 and rows["t"].exact_match_rate == 100


def test_word_distance_of_many_words(spark):
    a, b = [f"w{i}" for i in range(300)], [f"w{i}" for i in range(5, 300)]
    short = spark.createDataFrame([(a, b[:-5]), (["x"], []), ([], []), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in short.select(word_distance(F.col("a"), F.col("b"))).collect()] == [10, 1, 0, None]


def test_percentiles_by_rank(spark):
    rng = random.Random(3)
    rows = [(g, v) for g, n in (("a", 2000), ("b", 1), (None, 37)) for v in (rng.choice([1.5, 2.5, rng.gauss(0, 9)]) for _ in range(n))] + [("a", None), ("a", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in metrics.exact_percentiles(df, "v", ["g"], [0.0, 0.5, 0.9, 1.0]).collect()}
    for g in ("a", "b", None):
        values = [v for k, v in rows if k == g and v is not None and v == v]
        for p in (0, 50, 90, 100):
            assert got[g][f"p{p}"] == pytest.approx(np.percentile(values, p))
    assert set(got) == {"a", "b", None} and {r.g: r.p50 for r in metrics.latency(df, "v", ["g"]).collect()}["c"] is None


def test_review(spark):
    old = spark.createDataFrame([(1, "accepted", "x"), (2, "pending", "y"), (3, "pending", "z")], "k int, status string, decision string")
    new = spark.createDataFrame([(1, "pending", None), (2, "pending", "n"), (4, "pending", "m")], "k int, status string, decision string")
    assert sorted(map(tuple, review.merge_keep_review(old, new, ["k"], ["status", "decision"]).collect())) == [(1, "accepted", "x"), (2, "pending", "n"), (3, "pending", "z"), (4, "pending", "m")]
    assert [r.k for r in review.insert_new(old, new, ["k"]).collect()] == [4]
    edits = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (1, 3, 1), (2, 1, 5)], "doc long, seq long, expected long")
    assert sorted(map(tuple, review.revision_fold(edits).collect())) == [(1, 1, True, 1), (1, 2, False, 1), (1, 3, True, 2), (2, 1, False, 0)]


def test_ingest(spark):
    ocr = '{"result":{"ocrResults":[{"prunedResult":{"rec_texts":["one"," ","two","three"],"rec_scores":[0.9632,0.5,0.25],"dt_polys":[[[0,0]],[[1,1]],[[2,2]],[[3,3]]]}}]}}'
    rows = ingest.ocr_regions(spark.createDataFrame([("d", 0, ocr), ("d", 1, ocr), ("d", 2, "broken"), ("e", 0, None)], "doc string, line_no int, body string")).orderBy("ordinal").collect()
    assert [(r.region_id, r.text, r.is_illegible) for r in rows] == [("reg-p0-001", "one", False), ("reg-p0-002", "two", True), ("reg-p1-003", "one", False), ("reg-p1-004", "two", True)]
    layout = '{"result":{"layoutParsingResults":[{"prunedResult":{"width":1000,"height":1000,"layout_det_res":{"boxes":[{"order":1,"score":0.95},{"order":1,"score":0.91}]},"parsing_res_list":[{"block_id":"7","block_label":"Table","block_order":2,"block_bbox":[50,35,500,600],"block_content":"t"},{"block_label":"text","block_order":1,"block_bbox":[0,0,10,10],"block_content":"u"},{"block_label":"text","block_content":"v"}]},"markdown":{"text":"m"}}]}}'
    p = ingest.layout_pages(spark.createDataFrame([("d", 0, layout)], "doc string, line_no int, body string")).collect()[0]
    assert [b.content for b in p.blocks] == ["u", "t", "v"] and p.reading_order_sequence == ["7", "1", "2"] and p.tables_count == 1 and p.blocks[0].confidence == 0.91 and p.blocks[1].bounding_box.x == 5.0
