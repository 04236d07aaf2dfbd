"""Jobs as events (job, ts, state): current state, expiry, duplicate submissions; in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import JOBS, JobConfig


def current(events: DataFrame, key: str = "job", order: list[str] | None = None) -> DataFrame:
    """The last state of every job; map-side partial, no sort."""
    last = F.max(F.struct(*(order or ["ts", "seq"]), "state"))
    return events.groupBy(key).agg(last.alias("l"), F.max("ts").alias("last_pulse"), F.count_if(F.col("state") == "failed").alias("failures")).select(key, F.col("l.state").alias("state"), "last_pulse", "failures")


def is_stale(now: Column, heartbeat: Column, updated: Column, created: Column, cfg: JobConfig = JOBS) -> Column:
    return F.coalesce(heartbeat, updated, created) < now - F.make_dt_interval(secs=F.lit(cfg.stale_seconds))


def expire(jobs: DataFrame, now: Column, cfg: JobConfig = JOBS, to: str = "timed_out") -> DataFrame:
    """Active jobs without a pulse for too long get the state ``to``."""
    gone = F.col("state").isin(*cfg.active) & (F.col("last_pulse") < now - F.make_dt_interval(secs=F.lit(cfg.stale_seconds)))
    return jobs.withColumn("state", F.when(gone, to).otherwise(F.col("state")))


def poll(jobs: DataFrame, now: Column, working: Column, cfg: JobConfig = JOBS) -> DataFrame:
    """Jobs as a poll sees them: an active one that no worker holds and that is stale has failed once more."""
    gone = F.col("state").isin(*cfg.active) & ~working & (F.col("last_pulse") < now - F.make_dt_interval(secs=F.lit(cfg.stale_seconds)))
    return jobs.withColumns({"state": F.when(gone, "failed").otherwise(F.col("state")), "failures": F.col("failures") + F.when(gone, 1).otherwise(0)})


def watchdog(jobs: DataFrame, now: Column, started: Column, cfg: JobConfig = JOBS) -> DataFrame:
    """Active jobs that have run for too long in all have failed, pulse or no pulse."""
    over = F.col("state").isin(*cfg.active) & (started < now - F.make_dt_interval(secs=F.lit(cfg.most_seconds)))
    return jobs.withColumns({"state": F.when(over, "failed").otherwise(F.col("state")), "failures": F.col("failures") + F.when(over, 1).otherwise(0)})


def pulses(runs: DataFrame, key: str, start: str, end: str, every: int = 5) -> DataFrame:
    """The heartbeats (key, ts) of each run: one every so many seconds from its start on, while it lasts."""
    step = F.make_dt_interval(secs=F.lit(every))
    return runs.where(F.col(end) >= F.col(start)).select(key, F.explode(F.sequence(F.col(start), F.col(end), step)).alias("ts"))


def submissions(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Submissions (``kind`` submit or force; end is that of a job) with what becomes of them: started, joined to the active job, or started in its place.

    After any submission a job is active, until one ends; so the event before it decides, and no state has to be carried.
    """
    from pyspark.sql import Window

    before = F.lag("kind").over(Window.partitionBy(*keys).orderBy(*order))
    free = before.isNull() | (before == "end")
    outcome = F.when(free, "started").when(F.col("kind") == "force", "replaced").otherwise("joined")
    return events.withColumn("outcome", outcome).where(F.col("kind") != "end")


def first_submission(events: DataFrame, keys: list[str], gap_seconds: int) -> DataFrame:
    """Submissions that no other of the same key precedes within the gap."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ts", "seq"))
    return events.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("ts") - F.col("_before") > F.make_dt_interval(secs=F.lit(gap_seconds)))).drop("_before")


def stream_deduplicated(events: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def stream_expiry(events: DataFrame, delay: str = "0 seconds", cfg: JobConfig = JOBS) -> DataFrame:
    """A row for each change of a job's state, and one when event time passes its last pulse by the limit."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, ts = state.get
            state.remove()
            yield pd.DataFrame([(key[0], "timed_out", pd.Timestamp(ts, unit="us"))], columns=["job", "state", "ts"])
            return
        last, at = state.get if state.exists else (None, 0)
        out = []
        for frame in frames:
            for r in frame.sort_values("ts").itertuples(index=False):
                now = r.ts.value // 1000
                if now < at:
                    continue
                if r.state != last:
                    out.append((key[0], r.state, r.ts))
                last, at = r.state, now
        if last in cfg.active:
            state.update((last, at))
            state.setTimeoutTimestamp(max(at // 1000 + cfg.stale_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["job", "state", "ts"])

    return events.select("job", "ts", "state").withWatermark("ts", delay).groupBy("job").applyInPandasWithState(step, "job long, state string, ts timestamp", "state string, at long", "append", GroupStateTimeout.EventTimeTimeout)
