"""Parquet tables of one folder, read with explicit column pruning down to nested fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def pruned(schema: T.StructType, paths: list[str]) -> T.StructType:
    """The part of a nested schema that holds the dotted paths (arrays are passed through).

    Catalyst prunes plain nested fields by itself but not fields below two arrays, so scans of
    nested records are given their read schema. Raises KeyError for a path that is not there.
    """
    wanted: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        wanted.setdefault(head, []).append(rest)

    def cut(kind: T.DataType, rests: list[str]) -> T.DataType:
        if any(r == "" for r in rests):
            return kind
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(cut(kind.elementType, rests), kind.containsNull)
        return pruned(kind, rests)

    missing = set(wanted) - set(schema.fieldNames())
    if missing:
        raise KeyError(f"no such fields: {sorted(missing)}")
    return T.StructType([T.StructField(f.name, cut(f.dataType, wanted[f.name]), f.nullable) for f in schema.fields if f.name in wanted])


def nested_table(spark: SparkSession, folder: str, name: str, paths: list[str]) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(pruned(spark.read.parquet(path).schema, paths)).parquet(path)


#: Repeated keys that every task may hold.
REPEATED = 1_000_000


def first_deliveries(df: DataFrame, key: str, order: str, most: int = REPEATED) -> DataFrame:
    """One row per key, the first by ``order``; rows of one key are taken to be equal in all else.

    Only keys and order are shuffled while at most ``most`` keys are repeated: these are broadcast, and the rows pass by them where
    they lie. Beyond that whole rows are grouped, as are those of the few keys whose first row may be there twice. A null key is a key.
    """
    o = F.struct(order)
    again = df.groupBy(key).agg(F.min(o).alias("_first"), F.max(o).alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = again.select(F.col(key).alias("_key"), F.col(f"_first.{order}").alias("_first"), ((F.col("_n") > 2) | F.col("_first").eqNullSafe(F.col("_last"))).alias("_ties")).limit(most + 1).toArrow()
    if rows.num_rows > most:
        return df.withColumn("_o", o).groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), "_o").alias("_r")).select(*[F.col(c) if c == key else F.col(f"_r.{c}") for c in df.columns])
    if not rows.num_rows:
        return df
    ties = any(rows.column("_ties").to_pylist())
    known = df.sparkSession.createDataFrame(rows).withColumn("_again", F.lit(True)).drop("_ties")
    met = df.join(F.broadcast(known), F.col(key).eqNullSafe(F.col("_key")), "left")
    own = met.where(F.col("_again").isNull() | F.col("_first").eqNullSafe(F.col(order)))
    if not ties:
        return own.select(*df.columns)
    return met.where("_again IS NULL").unionByName(own.where("_again").dropDuplicates([key])).select(*df.columns)
