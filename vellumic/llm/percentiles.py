"""Queries over q-digests (problem 2): digests of single days are built once and combined to any coarser group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import first_deliveries
from . import qdigest

EPS = 0.005
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
GROUP = ("metric", "style_category", "model_identifier", "day")
#: The combinations that are reported, each merged from the day digests.
LEVELS = {"style": ("metric", "style_category"), "style_day": ("metric", "style_category", "day"), "style_model": ("metric", "style_category", "model_identifier")}


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """One row per evaluation and metric; an evaluation that was delivered twice counts once."""
    df = spark.read.parquet(f"{folder}/sample_evaluations.parquet").select("eval_id", "ingested_at", "style_category", "model_identifier", F.to_date("evaluated_at").alias("day"), "latency_sec", "cer")
    once = first_deliveries(df, "eval_id", "ingested_at")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("latency_sec", "cer")]))
    return once.select("style_category", "model_identifier", "day", pairs.alias("r")).select("style_category", "model_identifier", "day", "r.metric", "r.value")


def day_digests(spark: SparkSession, folder: str) -> DataFrame:
    """The stored form: digests per metric, style, model and day."""
    return qdigest.build(readings(spark, folder), GROUP, "value", EPS)


def percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles per style, per style and day, and per style and model, all merged from one set of day digests."""
    days = day_digests(spark, folder)
    # each day digest goes to every level it belongs to: one expansion, one merge, one pass over the data
    kinds = F.explode(
        F.array(*[F.struct(F.lit(level).alias("level"), *[(F.col(c) if c in keys else F.lit(None).cast(days.schema[c].dataType)).alias(c) for c in GROUP]) for level, keys in LEVELS.items()])
    )
    spread = days.select(kinds.alias("g"), "node", "cnt").select("g.*", "node", "cnt")
    group = ("level", *GROUP)
    return qdigest.quantiles(qdigest.merge(spread, group, EPS), group, PROBABILITIES, EPS)


def bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Per metric and style the readings, and whether every reported percentile lies within the guaranteed rank error of the exact rank."""
    told = percentiles(spark, folder).where("level = 'style'").select(F.col("metric").alias("_m"), F.col("style_category").alias("_s"), F.col("n").alias("_n"), *[f"p{p * 100:g}" for p in PROBABILITIES])
    v = F.col("value")
    rows = readings(spark, folder).where(v.isNotNull() & ~F.isnan(v)).join(told, (F.col("metric") == F.col("_m")) & F.col("style_category").eqNullSafe(F.col("_s")))
    margin = lambda c: F.abs(c) * 1.1 * qdigest.ALPHA + 2 * qdigest.TINY  # noqa: E731  # a cell's width
    edges = {p: (F.col(f"p{p * 100:g}") - margin(F.col(f"p{p * 100:g}")), F.col(f"p{p * 100:g}") + margin(F.col(f"p{p * 100:g}"))) for p in PROBABILITIES}
    own = rows.groupBy("metric", "style_category").agg(F.count(F.lit(1)).alias("n"), F.max("_n").alias("_n"), *[F.count_if(v < edges[p][0]).alias(f"_below{i}") for i, p in enumerate(PROBABILITIES)], *[F.count_if(v <= edges[p][1]).alias(f"_upto{i}") for i, p in enumerate(PROBABILITIES)])
    within = F.col("n") == F.col("_n")
    for i, p in enumerate(PROBABILITIES):
        within = within & (F.col(f"_upto{i}") >= p * F.col("n") - EPS * F.col("n") - 1) & (F.col(f"_below{i}") <= p * F.col("n") + EPS * F.col("n") + 1)
    return own.select("metric", "style_category", "n", within.alias("within"))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per metric and style: readings, and those that are null, NaN or negative."""
    v = F.col("value")
    return readings(spark, folder).groupBy("metric", "style_category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(v.isNull()).alias("n_null"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(~F.isnan(v) & (v < 0)).alias("n_negative")
    )


_ONE = "SELECT DISTINCT ON (eval_id) eval_id, style_category, {m} AS value, '{m}' AS metric FROM sample_evaluations"
QUERIES = {"p2_day_digests": day_digests, "p2_percentiles": percentiles, "p2_counts": counts, "p2_bounds": bounds}
SQL = {
    "p2_counts": (
        "SELECT metric, style_category, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE isnan(value)) AS n_nan, count(*) FILTER (WHERE NOT isnan(value) AND value < 0) AS n_negative "
        f"FROM (({_ONE.format(m='latency_sec')}) UNION ALL ({_ONE.format(m='cer')})) GROUP BY metric, style_category"
    ),
    "p2_bounds": f"SELECT metric, style_category, count(*) AS n, true AS within FROM (({_ONE.format(m='latency_sec')}) UNION ALL ({_ONE.format(m='cer')})) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY metric, style_category",
}
