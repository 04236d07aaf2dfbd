import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from vellumic.operators.shred import assemble, flatten, leaf_paths, levels, rebuild, shred, values_of
from vellumic.sources.layout_json import documents_of, parse_bodies, record_of

POINT = pa.list_(pa.float64())
BLOCK = pa.struct([("id", pa.string()), ("box", pa.struct([("x", pa.float64())])), ("poly", pa.list_(POINT))])
PAGE = pa.struct([("no", pa.int32()), ("blocks", pa.list_(BLOCK))])
PAGES = pa.list_(PAGE)

maybe = lambda s: st.one_of(st.none(), s)
block = st.fixed_dictionaries({"id": maybe(st.text("ab", max_size=2)), "box": maybe(st.fixed_dictionaries({"x": maybe(st.integers(0, 9).map(float))})), "poly": maybe(st.lists(maybe(st.lists(maybe(st.integers(0, 3).map(float)), max_size=2)), max_size=3))})
page = st.fixed_dictionaries({"no": maybe(st.integers(0, 9)), "blocks": maybe(st.lists(maybe(block), max_size=3))})
records = st.lists(maybe(st.lists(maybe(page), max_size=3)), max_size=5)


def brute_blocks(rows):
    return [
        (r, i, j, p["no"], b["id"], (b["box"] or {}).get("x"))
        for r, pages in enumerate(rows)
        for i, p in enumerate(pages or [])
        for j, b in enumerate((p or {}).get("blocks") or [])
        if b is not None
    ]


@settings(max_examples=150, deadline=None)
@given(records)
def test_levels_rebuild_every_table(rows):
    column = pa.array(rows, PAGES)
    cols = {p: levels(column, p) for p in ("no", "blocks.id", "blocks.box.x")}
    record, ords, values = rebuild(PAGES, "blocks", cols)
    got = list(zip(record.tolist(), ords[0].tolist(), ords[1].tolist(), values["no"].to_pylist(), values["blocks.id"].to_pylist(), values["blocks.box.x"].to_pylist()))
    assert got == brute_blocks(rows)
    record, ords, values = rebuild(PAGES, "blocks.poly", {"blocks.poly": levels(column, "blocks.poly")}, True)
    want = [(r, i, j, k, m, v) for r, ps in enumerate(rows) for i, p in enumerate(ps or []) for j, b in enumerate((p or {}).get("blocks") or []) for k, q in enumerate((b or {}).get("poly") or []) for m, v in enumerate(q or [])]
    assert list(zip(record.tolist(), *[o.tolist() for o in ords], values["blocks.poly"].to_pylist())) == want


@settings(max_examples=60, deadline=None)
@given(records, st.integers(0, 2))
def test_sliced_batches_are_the_same(rows, cut):
    column = pa.array([[{"no": 1, "blocks": []}]] * cut + rows, PAGES).slice(cut)
    for p in leaf_paths(PAGES):
        a, b = levels(column, p), levels(pa.array(rows, PAGES), p)
        assert a.rep.tolist() == b.rep.tolist() and a.dfn.tolist() == b.dfn.tolist() and values_of(a).to_pylist() == values_of(b).to_pylist()


def test_spark_shred_assemble_equals_flatten(spark):
    kind = "array<struct<no:int,blocks:array<struct<id:string,box:struct<x:double>>>>>"
    rows = [("a", [(1, [("b0", (1.5,)), None, (None, None)]), None, (None, [])]), ("b", None), ("c", []), ("d", [(7, None), (8, [("z", (None,))])]), ("d", [(7, None), (8, [("z", (None,))])])]
    df = spark.createDataFrame(rows, f"k string, pages {kind}").withColumn("ord_1x", __import__("pyspark").sql.functions.lit("clash"))
    leaves = {"no": "page_no", "blocks.id": "id", "blocks.box.x": "x"}
    flat = flatten(df, ["k"], "pages", "blocks", leaves)
    want = sorted(map(str, [("a", 0, 0, 1, "b0", 1.5), ("a", 0, 2, 1, None, None), ("d", 1, 0, 8, "z", None), ("d", 1, 0, 8, "z", None)]))
    assert sorted(str(tuple(r)) for r in flat.collect()) == want
    stored = shred(df, ["k"], "pages")
    assert stored.count() == 5
    again = assemble(stored, ["k"], df.schema["pages"].dataType, "blocks", leaves)
    assert sorted(str(tuple(r)) for r in again.collect()) == want
    assert flatten(df.limit(0), ["k"], "pages", "", {"no": "n"}).count() == 0
    nulls = flatten(df, ["k"], "pages", "blocks", leaves, keep_null_elements=True)
    assert nulls.count() == 5


def page_of(*ids, **more):
    return {"prunedResult": {"parsing_res_list": [None if i is None else {"block_id": i} for i in ids]}, **more}


def test_bodies_of_any_shape(spark):
    wrapped = {"data": {"result": {"layoutParsingResults": [page_of(0, "1", inputImage="u")]}}, "attempt": 2}
    string = {"result": json.dumps({"layoutParsingResults": [page_of(3)]})}
    single = {"result": {"layoutParsingResults": page_of(4, None, 5.0)}}
    lines = json.dumps(string) + "\n" + json.dumps(single) + "\n"
    ids = lambda b: [(p["page_ord"], [x and x["block_id"] for x in p["blocks"]]) for p in record_of(b)["pages"]]
    assert ids(json.dumps(wrapped)) == [(0, ["0", "1"])]
    assert ids(json.dumps(string)) == [(0, ["3"])]
    assert ids(json.dumps(single)) == [(0, ["4", None, "5"])]
    assert ids(lines) == [(0, ["3"]), (1, ["4", None, "5"])]
    assert record_of(json.dumps({"errorCode": 5})) == {"pages": []}
    for broken in (None, "", "  ", lines[:-9], json.dumps(single)[:-1], "nonsense"):
        assert record_of(broken) is None
    assert documents_of('{"a": 1}\n{"b"') is None
    df = spark.createDataFrame([("r1", lines), ("r2", None), ("r3", "{")], "response_id string, body string")
    out = parse_bodies(df, ["response_id"], "body").select("response_id", "body_record.pages")
    rows = flatten(out, ["response_id"], "pages", "blocks", {"blocks.block_id": "block_id"}).collect()
    assert sorted(map(tuple, rows)) == [("r1", 0, 0, "3"), ("r1", 1, 0, "4"), ("r1", 1, 2, "5")]
    assert isinstance(out.schema["pages"].dataType, T.ArrayType)
