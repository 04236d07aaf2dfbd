import duckdb

from vellumic.plans import nested as N
from vellumic.sources.layout_json import record_of

RAW = "raw_prescription_response"


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_all_three_sources_come_out(spark, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in (*N.NESTED, RAW):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    raw = {k: record_of(b) for k, b in con.execute(f"SELECT response_id, body FROM {RAW}").fetchall()}
    pages = {(k, i): p for k, r in raw.items() for i, p in enumerate((r or {"pages": []})["pages"]) if p}
    there = {(k, i, j): b for (k, i), p in pages.items() for j, b in enumerate(p["blocks"] or []) if b}
    blocks = N.blocks(spark, sf).cache()
    got = rows(blocks.where(f"source_table = '{RAW}'"), "record_id", "page_ord", "block_ord", "block_id", "content")
    assert got == {(*k, b["block_id"], b["block_content"] or "") for k, b in there.items()} and got
    plain = con.execute(f"SELECT source_table, record_id, page_ord, block_ord, block_id, content FROM ({N.SQL['p1_blocks']})").fetchall()
    assert rows(blocks, "source_table", "record_id", "page_ord", "block_ord", "block_id", "content") == set(plain)
    runs = N.runs(spark, sf).where(f"source_table = '{RAW}'").collect()
    assert len(runs) == len(raw) and {r.record_id: r.page_count for r in runs} == {k: r and len(r["pages"]) for k, r in raw.items()}
    points = N.polygon_points(spark, sf).cache()
    assert rows(points, "source_table", "record_id", "page_ord", "block_ord", "point_ord", "axis", "value") == set(con.execute(N.SQL["p1_polygon_points"]).fetchall())
    want = {(*k, n, a, v) for k, b in there.items() for n, q in enumerate(b["block_polygon_points"] or []) for a, v in enumerate(q or []) if v is not None}
    assert rows(points.where(f"source_table = '{RAW}'"), "record_id", "page_ord", "block_ord", "point_ord", "axis", "value") == want
    assert points.where("source_table = 'prescription_vl_result'").count() > 0
