"""All registered queries of the library proper and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import evidence, nested, stores, tables, workspace

MODULES = [evidence, tables, stores, workspace, nested]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.fusion_summary(spark, folder)
