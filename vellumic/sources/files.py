"""Uploaded files and JSON documents as tables, and the exports written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

SAMPLES = "dataset string, source string, dataset_sha256 string, total_samples int, samples array<struct<id:string,filename:string,ground_truth:string,sha256:string,byte_length:int,style_category:string>>"


def uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files of a folder with size, SHA-256, the type their bytes show, and why they would be refused. Spark's file source passes over files without a byte."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.regexp_replace("path", r"^.*/", "")
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    told = F.when(suffix == "pdf", "application/pdf").when(suffix.isin("jpg", "jpeg"), "image/jpeg").otherwise(F.concat(F.lit("image/"), suffix))
    return f.select(
        X.sanitize_filename(name).alias("filename"), F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"), X.mime_of(F.col("content")).alias("mime"), X.upload_error(F.col("content"), told, name).alias("error")
    )


def blob(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The content of one stored file by its name or id (the name's stem); only files of that name are opened."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"{name}*").load(path)
    stored = F.regexp_replace("path", r"^.*/", "")
    return f.where((stored == name) | (F.regexp_replace(stored, r"\.[^.]*$", "") == name)).select(stored.alias("name"), "length", "content")


def find_one(df: DataFrame, **equal: object) -> DataFrame:
    """At most one row for which all the given columns have these values."""
    for column, value in equal.items():
        df = df.where(F.col(column) == F.lit(value))
    return df.limit(1)


def benchmark_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The samples of benchmark metadata files, one JSON document each."""
    return spark.read.schema(SAMPLES).json(path, multiLine=True).select("dataset", F.posexplode("samples").alias("ord", "s")).select("dataset", "ord", "s.*")


def page_size(kind: Column, width: Column, height: Column, points_to_pixels: float = 2.77) -> Column:
    """Pixels of a page: points of a document scaled, pixels of an image, or a usual size where there is none."""
    w = F.when(kind == "application/pdf", F.coalesce((width * points_to_pixels).cast("int"), F.lit(1000))).otherwise(F.coalesce(width.cast("int"), F.lit(1000)))
    h = F.when(kind == "application/pdf", F.coalesce((height * points_to_pixels).cast("int"), F.lit(1414))).otherwise(F.coalesce(height.cast("int"), F.lit(1000)))
    return F.struct(w.alias("width"), h.alias("height"))


def by_any_id(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Rows of which any of several id columns holds the key."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c) == key, F.lit(False))
    return df.where(test)


def next_cursor(skip: int, limit: int, total: Column) -> Column:
    return F.when(F.lit(skip + limit) < total, F.lit(skip + limit))


def default_each_other(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Two names of one thing, each filled from the other."""
    return df.withColumns({c: F.coalesce(c, d) for a, b in pairs for c, d in ((a, b), (b, a))})


def export_transcripts(regions: DataFrame, keys: list[str], order: str, text: str, status: str) -> DataFrame:
    """One transcript per document in reading order, marked as a draft while regions are open, with its review as JSON."""
    open_ = F.count_if(F.col(status) == "pending")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("text"), F.col(status).alias("status"))))
    g = regions.groupBy(*keys).agg(open_.alias("unresolved"), rows.alias("rows"))
    head = F.when(F.col("unresolved") > 0, F.format_string("DRAFT - %d unresolved\n", F.col("unresolved"))).otherwise("")
    return g.select(*keys, "unresolved", F.concat(head, F.array_join(F.transform("rows", lambda r: r.text), "\n")).alias("transcript"), F.to_json(F.struct(*keys, F.lit("original_page_percent_xywh").alias("coordinate_space"), F.col("rows").alias("regions"))).alias("review_json"))
