import json

from pyspark.sql import functions as F

from vellumic.operators import store
from vellumic.sources import files


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    assert store.snapshot(spark, root) is None
    rows = lambda: sorted(map(tuple, store.snapshot(spark, root).collect()))
    df = lambda r: spark.createDataFrame(r, "k int, v string")
    store.save(spark, root, df([(1, "a"), (2, "b")]), ["k"], 1)
    store.save(spark, root, df([(2, "c"), (3, "d"), (3, "d")]), ["k"], 2)
    assert rows() == [(1, "a"), (2, "c"), (3, "d")]
    store.save(spark, root, df([(1, "z"), (4, None)]), ["k"], 3, replace=False)
    assert rows() == [(1, "a"), (2, "c"), (3, "d"), (4, None)]


def test_budget(spark):
    a = spark.createDataFrame([("d", 1, "x", 10), ("d", 2, "x", 10), ("d", 3, "y", 10), ("d", 4, "z", 10), ("e", 1, "x", 200_000), ("e", 2, "y", 1)], "doc string, n int, sha string, ms int")
    assert [r.status for r in store.budgeted(a, ["doc"], ["n"]).orderBy("doc", "n").collect()] == ["RUN", "DUPLICATE", "RUN", "BUDGET_EXHAUSTED", "TIMEOUT", "BUDGET_EXHAUSTED"]
    assert {r.status for r in store.budgeted(a, ["doc"], ["n"], provider=F.lit(False)).collect()} == {"PROVIDER_UNAVAILABLE"}


def test_filters(spark):
    d = spark.createDataFrame([(1, "a", "HIGH"), (2, "a", "LOW"), (3, "b", "LOW")], "t int, doc string, severity string")
    assert [r.t for r in store.filtered(d, "t", doc="a", severity=None).collect()] == [2, 1]
    assert [r.t for r in store.filtered(d, "t", most=1, doc=" ").collect()] == [3]
    assert [r.t for r in files.by_any_id(d, ["doc", "severity"], "b").collect()] == [3]
    assert spark.range(1).select(files.next_cursor(0, 20, F.lit(21)), files.next_cursor(20, 20, F.lit(21))).collect()[0] == (20, None)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "b.png").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in" / "c d.jpg").write_bytes(b"")
    got = {r.filename: (r.mime, r.error, r.byte_length) for r in files.uploads(spark, str(tmp_path / "in")).collect()}
    assert got["a.pdf"] == ("application/pdf", None, 10) and got["b.png"][1] == "SIGNATURE_MISMATCH"
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "d", "samples": [{"id": "s1", "ground_truth": "x"}, {"id": "s2"}]}, indent=1))
    assert [(r.dataset, r.ord, r.id, r.ground_truth) for r in files.benchmark_metadata(spark, str(tmp_path / "m.json")).collect()] == [("d", 0, "s1", "x"), ("d", 1, "s2", None)]


def test_transcript(spark):
    r = spark.createDataFrame([("d", 2, "b", "pending"), ("d", 1, "a", "accepted"), ("e", 1, None, "accepted")], "doc string, n int, text string, status string")
    got = {x.doc: x for x in files.export_transcripts(r, ["doc"], "n", "text", "status").collect()}
    assert got["d"].transcript == "DRAFT - 1 unresolved\na\nb" and got["e"].transcript == "" and len(json.loads(got["d"].review_json)["regions"]) == 2
