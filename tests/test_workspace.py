import datetime as dt

import pytest
from pyspark.sql import functions as F

from vellumic.functions import extract as P
from vellumic.functions import text as X
from vellumic.operators import metrics, review, store
from vellumic.sources import files
from vellumic.sources.providers import recognise
from vellumic.streaming import jobs

T0 = dt.datetime(2026, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def test_spans_take_room():
    html = "<table><tr><td rowspan=2>a</td><td colspan=2>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td>e</td></tr></table>"
    assert [(c["text"], c["row"], c["column"]) for c in P.laid_out(P.table_rows(html))] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 2), ("e", 2, 0)]
    assert P.laid_out(None) is None and P.laid_out([]) == []


def test_grid_as_a_column(spark):
    df = spark.createDataFrame([("<table><tr><td>x</td></tr></table>",), (None,), ("",)], "h string")
    assert [r[0] and [c.text for c in r[0]] for r in df.select(P.html_grid("h")).collect()] == [["x"], None, []]


def test_provider_is_an_argument(spark):
    def provider():
        def read(contents):
            if b"bad" in contents:
                raise ValueError("cannot read")
            return [(c.decode().upper(), 0.5) for c in contents]

        return read

    df = spark.createDataFrame([(1, b"ab", 9), (2, None, 9), (3, b"bad", 9)], "k int, content binary, text2 int").repartition(1).sortWithinPartitions("k")
    got = {r.k: (r.text, r.confidence, r.error) for r in recognise(df, "content", provider, batch=1).collect()}
    assert got == {1: ("AB", 0.5, None), 2: (None, None, None), 3: (None, None, "ValueError: cannot read")}
    assert recognise(df.limit(0), "content", provider).count() == 0


def test_blobs_and_points(spark, tmp_path):
    (tmp_path / "a1.pdf").write_bytes(b"one")
    (tmp_path / "a12.pdf").write_bytes(b"two")
    assert [bytes(r.content) for r in files.blob(spark, str(tmp_path), "a1.pdf").collect()] == [b"one"]
    assert [bytes(r.content) for r in files.blob(spark, str(tmp_path), "a1").collect()] == [b"one"]
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "k int, v string")
    assert files.find_one(df, v="x").count() == 1 and files.find_one(df, v="x", k=2).collect()[0].k == 2 and files.find_one(df, v="none").count() == 0


def test_runs(spark):
    runs = spark.createDataFrame([(1, "d", "k", "failed"), (2, "d", "k", "running"), (3, "d", "k", "completed"), (4, "e", None, "failed")], "id int, doc string, key string, status string")
    assert [tuple(r) for r in store.live_run(runs, ["doc", "key"]).collect()] == [("d", "k", 2)]
    done = store.finalize(runs, spark.createDataFrame([(2, 7)], "id int, regions int"), "id").collect()
    assert {r.id: (r.status, r.regions) for r in done} == {1: ("failed", None), 2: ("completed", 7), 3: ("completed", None), 4: ("failed", None)}
    children = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, n int, v string")
    assert {r.id: [c.v for c in r.own] for r in store.with_children(runs.select("id"), children, "id", ["n"], "own").collect()} == {1: ["a", "b"], 2: [], 3: [], 4: []}


def test_review_helpers(spark):
    r = spark.createDataFrame([("d", 1, True), ("d", 2, False), ("d", 3, True), ("e", 1, True), ("f", 1, False)], "doc string, region int, open boolean")
    assert {(x.doc, x.region): x.next_open for x in review.next_open(r, ["doc"], "region", F.col("open")).collect()} == {("d", 1): 3, ("d", 2): 1, ("d", 3): 1, ("e", 1): None, ("f", 1): None}
    states = ['{"text":"t","reviewed":true,"corrections":{"r1":"x","zz":"y"},"preferences":{"reviewer":"ann"},"events":[{"id":"1","action":"a","detail":"d","time":"2026-01-01"},{"id":"2"}]}', '{"text":"t","preferences":{"reviewer":" "},"corrections":{},"events":[]}', "broken", None]
    got = [x[0] for x in spark.createDataFrame([(s,) for s in states], "raw string").select(review.saved_state(F.col("raw"), ["r1"])).collect()]
    assert got[0].corrections == {"r1": "x"} and len(got[0].events) == 1 and got[0].reviewed and got[1:] == [None, None, None]
    views = spark.createDataFrame([(0.5, False), (0.95, False), (None, True), (0.5, True)], "c double, done boolean").select(review.queue_view(F.col("c"), F.col("done")).alias("v")).collect()
    assert [x.v for x in views] == [["all", "needs_review"], ["all"], ["all", "verified"], ["all", "verified"]]


def test_jobs(spark):
    now = F.lit(at(1000))
    e = spark.createDataFrame([(1, "running", at(0), 0), (2, "running", at(990), 0), (3, "completed", at(0), 1), (4, "queued", at(0), 2)], "job int, state string, last_pulse timestamp, failures int")
    assert {r.job: (r.state, r.failures) for r in jobs.poll(e, now, F.col("job") == 4).collect()} == {1: ("failed", 1), 2: ("running", 0), 3: ("completed", 1), 4: ("queued", 2)}
    started = e.withColumn("started", F.when(F.col("job") == 2, F.lit(at(700))).otherwise(F.lit(at(900))))
    assert {r.job: r.state for r in jobs.watchdog(started, now, F.col("started")).collect()} == {1: "running", 2: "failed", 3: "completed", 4: "queued"}
    runs = spark.createDataFrame([(1, at(0), at(12)), (2, at(5), at(0))], "job int, a timestamp, b timestamp")
    assert sorted(r.ts for r in jobs.pulses(runs, "job", "a", "b").collect()) == [at(0), at(5), at(10)]
    s = spark.createDataFrame([("d", i, k) for i, k in enumerate(["submit", "submit", "force", "end", "end", "submit"])], "doc string, n int, kind string")
    assert [r.outcome for r in jobs.submissions(s, ["doc"], ["n"]).orderBy("n").collect()] == ["started", "joined", "replaced", "started"]


@pytest.mark.parametrize("raw,want", [("2026-01-02T03:04:05Z", "2026-01-02T03:04:05"), ("2026-01-02T03:04:05", "2026-01-02T03:04:05"), ("2026-01-02T03:04:05+01:00", "2026-01-02T02:04:05"), ("x", None), (None, None)])
def test_times(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "t string").select(X.iso(X.to_utc(F.col("t")))).collect()[0][0]
    assert (got and got[:19]) == want


def test_small_columns(spark):
    df = spark.createDataFrame([([0.5, None, 1.0],), ([],), (None,)], "p array<double>")
    assert [r[0] for r in df.select(metrics.mean_probability(F.col("p"))).collect()] == [0.75, 0.0, 0.0]
    e = spark.createDataFrame([(0, "j", "m"), (0, "", "m"), (10010, None, None), (None, "j", None)], "c int, j string, m string")
    assert [r[0] for r in e.select(X.envelope_error(F.col("c"), F.col("j"), F.col("m"))).collect()] == [None, "m", "QUEUE_FULL", "UNKNOWN"]
    p = spark.createDataFrame([("Mrs Ann Bee", "34 y/f"), ("Ann Bee", "old"), (None, None)], "n string, a string").select(P.person(F.col("n")).alias("p"), P.age_sex(F.col("a")).alias("a")).collect()
    assert [(r.p.salutation, r.p.name, r.a.age, r.a.unit, r.a.sex) for r in p] == [("Mrs.", "Ann Bee", 34, "Y", "F"), (None, "Ann Bee", None, None, None), (None, None, None, None, None)]
