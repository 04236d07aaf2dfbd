"""Provider bodies (JSON text) as nested records of one fixed type, whatever their wrapping.

A body is one JSON document or one per line. Pages are the elements of every ``layoutParsingResults``
in it, in order; the member may be nested in other members, be a JSON text in a string, or hold a
single page object instead of a list. A body that is null, empty or not complete JSON gives a null
record; a failure without pages gives an empty list of pages. Numbers and texts are taken for each
other where a field's type asks for it; what can not be converted is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK = T.StructType(
    [
        T.StructField("block_id", T.StringType()),
        T.StructField("block_label", T.StringType()),
        T.StructField("block_content", T.StringType()),
        T.StructField("block_order", T.IntegerType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("block_bbox", T.ArrayType(T.DoubleType())),
        T.StructField("block_polygon_points", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)
BOX = T.StructType([T.StructField("order", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("label", T.StringType())])
PAGE = T.StructType(
    [
        T.StructField("page_ord", T.IntegerType()),
        T.StructField("inputImage", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("markdown_text", T.StringType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
        T.StructField("boxes", T.ArrayType(BOX)),
    ]
)
BODY = T.StructType([T.StructField("pages", T.ArrayType(PAGE))])
PAGES_KEY = "layoutParsingResults"


def documents_of(body: str | None) -> list[Any] | None:
    """The JSON documents of a body, or None if it is not complete JSON."""
    if body is None or not body.strip():
        return None
    try:
        return [json.loads(body)]
    except (ValueError, RecursionError):
        pass
    try:
        lines = [line for line in body.splitlines() if line.strip()] if "\n" in body else []
        return [json.loads(line) for line in lines] or None
    except (ValueError, RecursionError):
        return None


def pages_of(value: Any) -> Iterator[Any]:
    """Page elements in document order, through any wrapping."""
    todo = [value]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if PAGES_KEY in item:
                try:
                    todo.append(json.loads(item))
                except (ValueError, RecursionError):
                    continue
        elif isinstance(item, list):
            todo.extend(reversed(item))
        elif isinstance(item, dict):
            if PAGES_KEY in item:
                found = item[PAGES_KEY]
                if isinstance(found, str):
                    try:
                        found = json.loads(found)
                    except (ValueError, RecursionError):
                        found = None
                yield from found if isinstance(found, list) else [] if found is None else [found]
            todo.extend(reversed([v for k, v in item.items() if k != PAGES_KEY]))


def _text(x: Any) -> str | None:
    if x is None or isinstance(x, str):
        return x
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x)


def _number(x: Any) -> float | None:
    try:
        return None if isinstance(x, bool) or x is None else float(x)
    except (TypeError, ValueError):
        return None


def _int(x: Any) -> int | None:
    y = _number(x)
    return int(y) if y is not None and y == y and abs(y) < 2**31 else None


def _numbers(x: Any) -> list[float | None] | None:
    return [_number(v) for v in x] if isinstance(x, list) else None


def _dict(x: Any) -> dict:
    return x if isinstance(x, dict) else {}


def _block(b: Any) -> dict | None:
    if not isinstance(b, dict):
        return None
    polygon = b.get("block_polygon_points")
    return {
        "block_id": _text(b.get("block_id")),
        "block_label": _text(b.get("block_label")),
        "block_content": _text(b.get("block_content")),
        "block_order": _int(b.get("block_order")),
        "group_id": _text(b.get("group_id")),
        "block_bbox": _numbers(b.get("block_bbox")),
        "block_polygon_points": [_numbers(p) for p in polygon] if isinstance(polygon, list) else None,
    }


def record_of(body: str | None) -> dict | None:
    documents = documents_of(body)
    if documents is None:
        return None
    pages = []
    for i, page in enumerate(p for d in documents for p in pages_of(d)):
        if not isinstance(page, dict):
            pages.append(None)
            continue
        layout, blocks, boxes = _dict(page.get("prunedResult")), None, None
        if isinstance(layout.get("parsing_res_list"), list):
            blocks = [_block(b) for b in layout["parsing_res_list"]]
        if isinstance(_dict(layout.get("layout_det_res")).get("boxes"), list):
            boxes = [{"order": _int(b.get("order")), "score": _number(b.get("score")), "label": _text(b.get("label"))} if isinstance(b, dict) else None for b in layout["layout_det_res"]["boxes"]]
        pages.append(
            {
                "page_ord": i,
                "inputImage": _text(page.get("inputImage")),
                "width": _int(layout.get("width")),
                "height": _int(layout.get("height")),
                "markdown_text": _text(_dict(page.get("markdown")).get("text")),
                "blocks": blocks,
                "boxes": boxes,
            }
        )
    return {"pages": pages}


def parse_bodies(df: DataFrame, keys: list[str], body: str, into: str = "body_record") -> DataFrame:
    """The keys and the body as a nested record of type ``BODY``; one Arrow pass, no shuffle."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(into, BODY)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):  # parsed JSON is much larger than its text
                part = batch.slice(start, 200)
                records = [record_of(b) for b in part.column(body).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(k).cast(target.field(k).type) for k in keys], pa.array(records, target.field(into).type)], schema=target)

    return df.select(*keys, body).mapInArrow(run, schema)
