"""Recognition quality: character and word error rates, exact matches, numbers, latency.

Input: ground_truth, prediction, latency (seconds). All rates are micro-averaged: edits over reference length.
Empty references count no characters; an empty prediction costs its whole reference. Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.edit import word_distance
from ..functions.text import digits


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)


def scored(df: DataFrame, words: bool = True) -> DataFrame:
    """Adds edits and lengths per row, all in the JVM."""
    gt, pr = F.coalesce("ground_truth", F.lit("")), F.coalesce("prediction", F.lit(""))
    split = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    out = df.withColumns({"char_edits": F.when(gt == pr, 0).otherwise(F.levenshtein(gt, pr)).cast("long"), "chars": F.length(gt).cast("long"), "exact": gt == pr, "gt_digits": digits(gt), "pred_digits": digits(pr)})
    return out.withColumns({"word_edits": word_distance(split(gt), split(pr)), "words": F.size(split(gt)).cast("long")}) if words else out


def summary(rows: DataFrame, by: list[str], words: bool = True) -> DataFrame:
    wanted = [
        F.count(F.lit(1)).alias("samples"), F.sum("chars").alias("characters"), _ratio(F.sum("char_edits"), F.sum("chars")).alias("cer"),
        F.round(F.avg(F.col("exact").cast("double")) * 100, 6).alias("exact_match_rate"), _ratio(F.count_if((F.col("gt_digits") != "") & (F.col("gt_digits") != F.col("pred_digits"))), F.count_if(F.col("gt_digits") != "")).alias("numeric_error_rate"),
    ]
    if words:
        wanted += [F.sum("words").alias("words"), _ratio(F.sum("word_edits"), F.sum("words")).alias("wer")]
    return rows.groupBy(*by).agg(*wanted)


SPLITS = 64


def exact_percentiles(df: DataFrame, value: str, by: list[str], probabilities: list[float]) -> DataFrame:
    """Per group the exact percentiles, linear between neighbours, as ``p50`` and so on; null and NaN are left out.

    Equal values are counted first. The different values of a group are cut into ranges of about equal size; the counts of the
    ranges say in which of them a rank lies, and only those ranges are sorted, each by itself. So a group may have any size.
    """
    x = F.col(value)
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by, x.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx("_v", [i / SPLITS for i in range(1, SPLITS)], 1000).alias("_cuts"))
    placed = counts.alias("c").join(cuts.alias("k"), [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by])
    placed = placed.select(*[F.col(f"c.{c}") for c in by], "_v", "_n", F.size(F.filter("_cuts", lambda s: s < F.col("_v"))).alias("_range"))
    heap = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    w = Window.partitionBy(*by)  # at most SPLITS rows a group
    heap = heap.withColumns({"_upto": F.sum("_sum").over(w.orderBy("_range")), "_all": F.sum("_sum").over(w)}).withColumn("_before", F.col("_upto") - F.col("_sum"))
    rank = F.array(*[F.struct(F.lit(f"p{p * 100:g}").alias("name"), (F.lit(p) * (F.col("_all") - 1)).alias("at")) for p in probabilities])
    wanted = heap.withColumn("_p", F.explode(rank)).where((F.floor("_p.at") < F.col("_upto")) & (F.ceil("_p.at") >= F.col("_before")))
    wanted = wanted.groupBy(*by, "_range", "_before").agg(F.collect_list("_p").alias("_ps"))
    near = placed.alias("c").join(wanted.alias("k"), [F.col("c._range") == F.col("k._range")] + [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by])
    near = near.select(*[F.col(f"c.{c}") for c in by], F.col("c._range").alias("_range"), "_v", "_n", "_before", "_ps")
    near = near.withColumn("_cum", F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_v"))).withColumn("_p", F.explode("_ps"))
    ends = near.groupBy(*by, F.col("_p.name").alias("_name"), F.col("_p.at").alias("_at")).agg(*[F.min(F.when(F.col("_cum") > f("_p.at"), F.col("_v"))).alias(n) for n, f in (("_lo", F.floor), ("_hi", F.ceil))])
    point = F.col("_lo") + (F.col("_at") - F.floor("_at")) * (F.col("_hi") - F.col("_lo"))
    point = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(point)
    return ends.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == f"p{p * 100:g}", point)).alias(f"p{p * 100:g}") for p in probabilities])


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, exact interpolated percentiles and extremes."""
    plain = df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.min(value), 6).alias("least"), F.round(F.max(value), 6).alias("most"))
    points = exact_percentiles(df, value, by, [0.5, 0.9, 0.95])
    joined = plain.alias("a").join(points.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], "left")
    return joined.select(*[F.col(f"a.{c}") for c in by], "mean", *[F.round(p, 6).alias(p) for p in ("p50", "p90", "p95")], "least", "most")


def dataset_hash(df: DataFrame, order: str, digest: Column) -> DataFrame:
    """SHA-256 of all row digests in order. One text of all digests by definition, so for tables that fit one row; see ``dataset_tree``."""
    return df.select(F.col(order).alias("o"), digest.alias("h")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda r: r.h), ""), 256).alias("dataset_sha256"))


def dataset_tree(df: DataFrame, key: str, digest: Column, width: int = 3) -> DataFrame:
    """The same for tables of any size: digests are hashed in order of their keys within ``16 ** width`` leaves, then leaf by leaf."""
    rows = df.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, width).alias("leaf"), F.col(key).alias("o"), digest.alias("h"))
    joined = lambda c, f: F.array_join(F.transform(F.array_sort(F.collect_list(c)), f), "")
    leaves = rows.groupBy("leaf").agg(F.sha2(joined(F.struct("o", "h"), lambda r: r.h), 256).alias("h"))
    return leaves.agg(F.sha2(joined(F.struct("leaf", "h"), lambda r: r.h), 256).alias("tree_sha256"), F.count(F.lit(1)).alias("leaves"))


def mean_probability(values: Column) -> Column:
    """Mean of the token probabilities of a reading, null ones left out; 0.0 where there are none."""
    there = F.filter(values, lambda v: v.isNotNull())
    return F.coalesce(F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(there), F.lit(0)), F.lit(0.0))


def report(rows: DataFrame, by: str) -> DataFrame:
    """A summary as one Markdown table and one JSON text, groups in order. One row per group goes in: a small table."""
    cells = F.concat_ws(" | ", F.col(by), F.col("samples").cast("string"), F.format_string("%.4f", "cer"), F.format_string("%.2f", "exact_match_rate"))
    line = F.struct(F.col(by).alias("k"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"), F.to_json(F.struct(by, "samples")).alias("json"))
    all_ = rows.agg(F.array_sort(F.collect_list(line)).alias("l"))
    head = f"| {by} | samples | cer | exact |\n|---|---|---|---|\n"
    return all_.select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("markdown"), F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x.json), ","), F.lit("]")).alias("json"))
