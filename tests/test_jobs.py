import datetime as dt

from pyspark.sql import functions as F

from vellumic.streaming import jobs

T0 = dt.datetime(2026, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def test_batch_expiry(spark):
    e = spark.createDataFrame([(1, at(0), 1, "running"), (1, at(5), 2, "running"), (2, at(0), 3, "running"), (2, at(9), 4, "completed"), (3, at(190), 5, "queued")], "job long, ts timestamp, seq long, state string")
    now = F.lit(at(200))
    assert {(r.job, r.state) for r in jobs.expire(jobs.current(e), now).collect()} == {(1, "timed_out"), (2, "completed"), (3, "queued")}
    none = F.lit(None).cast("timestamp")
    assert spark.range(1).select(jobs.is_stale(now, none, none, F.lit(at(0))), jobs.is_stale(now, F.lit(at(150)), none, F.lit(at(0)))).collect()[0] == (True, False)


def test_stream_expiry_equals_batch(spark, tmp_path):
    rows = [(1, at(0), "running"), (1, at(60), "running"), (2, at(0), "queued"), (2, at(30), "completed"), (3, at(100), "running")]
    src, out = str(tmp_path / "in"), str(tmp_path / "ck")
    spark.createDataFrame(rows, "job long, ts timestamp, state string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("job long, ts timestamp, state string").option("maxFilesPerTrigger", 1).parquet(src)
    q = jobs.stream_expiry(stream).writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", out).start()
    try:
        q.processAllAvailable()
        for i in range(2):
            spark.createDataFrame([(9 + i, at(1000 + i), "completed")], "job long, ts timestamp, state string").coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.job, r.state) for r in spark.sql("select * from expired").collect()}
    assert {(1, "running"), (1, "timed_out"), (2, "completed"), (3, "timed_out"), (9, "completed")} <= got and (2, "timed_out") not in got


def test_first_submission(spark):
    e = spark.createDataFrame([("a", at(0), 1), ("a", at(10), 2), ("a", at(500), 3), ("b", at(1), 4)], "k string, ts timestamp, seq long")
    assert sorted(r.seq for r in jobs.first_submission(e, ["k"], 60).collect()) == [1, 3, 4]
