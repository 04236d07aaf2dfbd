"""Tables of entities on plain Parquet: appends without second keys, snapshot rewrites, run and attempt records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import RECOVER, RecoverConfig
from .review import insert_new, upsert


def snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete snapshot of an entity table, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = sorted(s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(f"{root}/{done[-1]}") if done else None


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A new snapshot beside the old ones; readers see it once it is complete."""
    to = f"{root}/v{version:012d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(to)
    return to


def save(spark: SparkSession, root: str, new: DataFrame, keys: list[str], version: int, replace: bool = True) -> str:
    """Rows added to a table: those with a known key replace it, or are left out."""
    old = snapshot(spark, root)
    rows = new if old is None else upsert(old, new.dropDuplicates(keys), keys) if replace else old.unionByName(insert_new(old, new, keys))
    return write_snapshot(rows, root, version)


def stable_id(prefix: str, *keys: Column) -> Column:
    """Ids that a repeated run makes again."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 8))


def live_run(runs: DataFrame, keys: list[str], key: str = "id", status: str = "status", failed: tuple[str, ...] = ("failed",)) -> DataFrame:
    """Per document and idempotency key the first run that has not failed."""
    return runs.where(~F.col(status).isin(*failed)).groupBy(*keys).agg(F.min(key).alias(key))


def finalize(runs: DataFrame, counters: DataFrame, key: str, status: str = "completed") -> DataFrame:
    """Runs with their counters and final status; runs without counters stay as they are."""
    own = counters.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in counters.columns if c != key])
    both = runs.join(own, F.col(key) == F.col("_key"), "left")
    done = F.col("_key").isNotNull()
    new = {c: F.when(done, F.col(f"_{c}")).otherwise(F.col(c)) if c in runs.columns else F.col(f"_{c}") for c in counters.columns if c != key}
    return both.withColumns(new | {"status": F.when(done, status).otherwise(F.col("status"))}).select(*runs.columns, *[c for c in new if c not in runs.columns])


def with_children(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array, empty where there are none."""
    rest = [c for c in children.columns if c not in (key, *order)]
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
    none = F.array().cast(rows.schema[name].dataType)
    return parents.join(rows, key, "left").withColumn(name, F.coalesce(name, none))


def budgeted(attempts: DataFrame, keys: list[str], order: list[str], cfg: RecoverConfig = RECOVER, provider: Column | None = None) -> DataFrame:
    """Attempts (sha, ms) of a region: a variant seen before is skipped, then at most so many, within so much time.

    Without a provider none is run; one that takes more than the whole time has timed out.
    """
    seen = F.row_number().over(Window.partitionBy(*keys, "sha").orderBy(*order))
    rest = attempts.withColumn("_copy", seen > 1)
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.sum(F.when(F.col("_copy"), 0).otherwise(1)).over(w)
    spent = F.coalesce(F.sum(F.when(F.col("_copy"), F.lit(0)).otherwise(F.col("ms"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    status = F.when(F.lit(False) if provider is None else ~provider, "PROVIDER_UNAVAILABLE").when(F.col("_copy"), "DUPLICATE").when((n > cfg.most_variants) | (spent >= cfg.wall_ms), "BUDGET_EXHAUSTED").when(F.col("ms") > cfg.wall_ms, "TIMEOUT").otherwise("RUN")
    return rest.withColumn("status", status).drop("_copy")


def link_attempts(proposals: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals with the ids of their attempts added."""
    ids = attempts.groupBy(*keys).agg(F.array_sort(F.collect_set("attempt_id")).alias("_ids"))
    there = F.coalesce("attempt_ids", F.array().cast("array<string>"))
    return proposals.join(ids, keys, "left").withColumn("attempt_ids", F.array_union(there, F.coalesce("_ids", F.array().cast("array<string>")))).drop("_ids")


def filtered(df: DataFrame, newest: str, most: int | None = None, **equal: str | None) -> DataFrame:
    """The conjunction of the filters that are given (None and blanks are not), newest first; ``most`` rows where a page is asked for."""
    for column, value in equal.items():
        if value is not None and str(value).strip():
            df = df.where(F.col(column) == value)
    df = df.orderBy(F.col(newest).desc())
    return df if most is None else df.limit(most)
