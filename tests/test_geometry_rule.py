import duckdb
from pyspark.sql import functions as F

from vellumic.operators import align as A
from vellumic.plans import evidence as P
from vellumic.plans import fixtures as V


def test_geometry_rule_fires_in_the_queries(spark, tmp_path):
    """A region of several readings whose pair in the alignment lies apart; all else as the SQL has it."""
    sf = str(tmp_path)
    spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").where("l_orderkey IN (1, 2, 3, 166, 761, 2087)").coalesce(1).write.parquet(f"{sf}/lineitem.parquet")
    single = {(x.doc, x.region) for x in V.readings(spark, sf).groupBy("doc", "region").count().where("count = 1").collect()}
    far = A.align(V.regions(spark, sf), V.blocks(spark, sf)).where((F.col("status") == "one_to_one") & (F.round("iou", 4) < 0.05)).collect()
    want = {(x.doc, x.region) for x in far} - single
    rows = [tuple(x) for x in P.detect_all(spark, sf).select("doc", "region", "type", "severity", "n").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
    others = con.execute(P.SQL["detect_all"]).fetchall()
    assert want
    assert sorted(rows) == sorted(others) and {r[:2] for r in rows if r[2] == "GEOMETRY_MISMATCH"} == want
    assert {(x.doc, x.region) for x in P.region_evidence(spark, sf).where("reasons LIKE '%GEOMETRY_MISMATCH%'").collect()} == want
