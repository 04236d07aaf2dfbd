"""Flat tables of the nested export, result and provider records (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.ingest import _score
from ..operators.shred import flatten
from ..session import wide_batches
from ..sources.layout_json import parse_bodies
from ..sources.tables import nested_table, table

#: nested table -> (column with the pages, prefix of its fields, record key)
NESTED = {
    "payload": ("parsing_run.pages", "parsing_run.id"),
    "prescription_vl_result": ("pages", "result_id"),
}
BLOCK_LEAVES = ["page_index", "block_id", "block_type", "content", "reading_order", "confidence", "bounding_box.x", "bounding_box.y", "bounding_box.w", "bounding_box.h"]


def pages_frame(spark: SparkSession, folder: str, name: str, leaves: list[str]) -> DataFrame:
    """``record_id`` and ``pages`` of a nested table, with only these leaves of a page read from the files."""
    pages, key = NESTED[name]
    df = nested_table(spark, folder, name, [key, *[f"{pages}.{p}" for p in leaves]])
    return df.select(F.col(key).alias("record_id"), F.col(pages).alias("pages"))


def raw_frame(spark: SparkSession, folder: str) -> DataFrame:
    return parse_bodies(table(spark, folder, "raw_prescription_response", "response_id", "body"), ["response_id"], "body").select(F.col("response_id").alias("record_id"), F.col("body_record.pages").alias("pages"))


def found(spark: SparkSession, folder: str) -> DataFrame:
    """One row per block that lies in the nested records of the three tables."""
    wide_batches(spark)
    parts = []
    for name in NESTED:
        rows = flatten(pages_frame(spark, folder, name, ["page_index", "blocks.block_id"]), ["record_id"], "pages", "blocks", {"page_index": "own_index", "blocks.block_id": "block_id"})
        parts.append(rows.select(F.lit(name).alias("source_table"), "record_id", F.coalesce("own_index", "ord_1").cast("int").alias("page_index"), "block_id"))
    rows = flatten(raw_frame(spark, folder), ["record_id"], "pages", "blocks", {"blocks.block_id": "block_id"})
    parts.append(rows.select(F.lit("raw_prescription_response").alias("source_table"), "record_id", F.col("ord_1").cast("int").alias("page_index"), "block_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run, result or raw response, with its parent document."""
    run = nested_table(spark, folder, "payload", [f"parsing_run.{c}" for c in ("id", "document_id", "job_id", "provider_id", "model_version", "page_count", "total_blocks", "execution_time_ms")]).select("parsing_run.*")
    result = nested_table(spark, folder, "prescription_vl_result", ["result_id", "document_id", "metadata.provider_name", "metadata.model_version", "metadata.parameters", "total_blocks", "execution_time_ms"])
    one = run.select(F.lit("payload").alias("source_table"), F.col("id").alias("record_id"), "document_id", "job_id", "provider_id", "model_version", "page_count", "total_blocks", "execution_time_ms")
    two = result.select(
        F.lit("prescription_vl_result").alias("source_table"), F.col("result_id").alias("record_id"), "document_id", F.col("metadata.parameters.cloud_job_id").alias("job_id"), F.col("metadata.provider_name").alias("provider_id"), F.col("metadata.model_version").alias("model_version"),
        F.col("metadata.parameters.pages_parsed").alias("page_count"), "total_blocks", "execution_time_ms",
    )
    return one.unionByName(two).distinct().unionByName(raw_runs(spark, folder))


def raw_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row per raw response, with the document of its first delivery; counts are null where the body is broken."""
    body = parse_bodies(table(spark, folder, "raw_prescription_response", "response_id", "document_id", "received_at", "body"), ["response_id", "document_id", "received_at"], "body")
    there = F.transform("body_record.pages", lambda p: F.size(F.filter(F.coalesce(p.blocks, F.array()), lambda b: b.isNotNull())))
    one = body.select(F.col("response_id").alias("record_id"), "document_id", "received_at", F.size(there).alias("page_count"), F.aggregate(there, F.lit(0), lambda a, n: a + n).alias("total_blocks"), F.col("body_record").isNotNull().alias("whole"))
    first = F.min_by("document_id", F.struct(F.col("document_id").isNull(), "received_at", "document_id"))
    count = lambda c: F.max(F.when(F.col("whole"), F.col(c))).alias(c)
    rows = one.groupBy("record_id").agg(first.alias("document_id"), count("page_count"), count("total_blocks"))
    none = {c: F.lit(None).cast("string") for c in ("job_id", "provider_id", "model_version")}
    return rows.withColumns({"source_table": F.lit("raw_prescription_response"), **none, "execution_time_ms": F.lit(None).cast("double")})


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page, keyed (source_table, record_id, page_ord); inputImage where a provider body has one."""
    wide_batches(spark)
    parts = []
    names = ["page_index", "width", "height", "tables_count"]
    for name in NESTED:
        rows = flatten(pages_frame(spark, folder, name, names), ["record_id"], "pages", "", {n: n for n in names})
        parts.append(rows.select(F.lit(name).alias("source_table"), "record_id", F.col("ord_1").alias("page_ord"), *names, F.lit(None).cast("string").alias("inputImage")))
    raw = flatten(raw_frame(spark, folder), ["record_id"], "pages", "", {"width": "width", "height": "height", "inputImage": "inputImage"})
    parts.append(raw.select(F.lit("raw_prescription_response").alias("source_table"), "record_id", F.col("ord_1").alias("page_ord"), F.lit(None).cast("int").alias("page_index"), "width", "height", F.lit(None).cast("int").alias("tables_count"), "inputImage"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per block, keyed (source_table, record_id, page_ord, block_ord), boxes spread over columns."""
    wide_batches(spark)
    parts = []
    for name in NESTED:
        leaves = {f"blocks.{p}": p.replace(".", "_") for p in BLOCK_LEAVES}
        rows = flatten(pages_frame(spark, folder, name, list(leaves)), ["record_id"], "pages", "blocks", leaves)
        parts.append(rows.withColumnsRenamed({"ord_1": "page_ord", "ord_2": "block_ord"}).withColumn("source_table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(raw_blocks(spark, folder)).distinct()


def raw_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of raw bodies under the names of the typed ones; block_id as stored, page_index by position."""
    page = raw_frame(spark, folder).select("record_id", F.posexplode("pages").alias("page_ord", "p"))
    row = page.select("record_id", "page_ord", "p.width", "p.height", "p.boxes", F.posexplode("p.blocks").alias("block_ord", "b")).where("b IS NOT NULL")
    row = row.withColumn("reading_order", F.coalesce("b.block_order", F.col("block_ord") + 1)).withColumn("box", G.from_corners(F.col("b.block_bbox"), F.nullif("width", F.lit(0)), F.nullif("height", F.lit(0))))
    return row.select(
        F.lit("raw_prescription_response").alias("source_table"), "record_id", "page_ord", "block_ord", F.col("page_ord").alias("page_index"), "b.block_id", F.coalesce("b.block_label", F.lit("text")).alias("block_type"),
        F.coalesce("b.block_content", F.lit("")).alias("content"), "reading_order", _score(F.col("boxes"), F.col("reading_order")).alias("confidence"), *[F.col(f"box.{c}").alias(f"bounding_box_{c}") for c in "xywh"],
    )


def polygon_points(spark: SparkSession, folder: str) -> DataFrame:
    """One row per coordinate of a block's polygon: the grandchildren of a page, four lists deep."""
    wide_batches(spark)
    parts = []
    for name in (*NESTED, "raw_prescription_response"):
        leaf = "blocks.polygon" if name in NESTED else "blocks.block_polygon_points"
        rows = flatten(pages_frame(spark, folder, name, [leaf]) if name in NESTED else raw_frame(spark, folder), ["record_id"], "pages", leaf, {leaf: "value"})
        parts.append(rows.withColumnsRenamed({"ord_1": "page_ord", "ord_2": "block_ord", "ord_3": "point_ord", "ord_4": "axis"}).withColumn("source_table", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


_BLOCK_SQL = ", ".join(f"b.{p} AS {p.replace('.', '_')}" for p in BLOCK_LEAVES)


def _pages_sql(name: str) -> str:
    """rid, po, p: the pages of a typed table."""
    pages, key = NESTED[name]
    return f"SELECT {key} AS rid, unnest({pages}) AS p, unnest(range(len({pages}))) AS po FROM {name}"


def _blocks_sql(name: str) -> str:
    return f"SELECT '{name}' AS source_table, rid, po, p, unnest(p.blocks) AS b, unnest(range(len(p.blocks))) AS bo FROM ({_pages_sql(name)})"


# pages of raw bodies: one document or one per line, wrapped in ``data`` or not, the result as JSON or as its text, one page or a list
RAW = (
    "rb AS (SELECT row_number() OVER () AS delivery, response_id AS rid, document_id, received_at, CASE WHEN json_valid(body) THEN [body] WHEN len(list_filter(string_split(body,chr(10)), lambda l: trim(l)<>''))>0 AND len(list_filter(string_split(body,chr(10)), lambda l: trim(l)<>'' AND NOT json_valid(l)))=0 THEN list_filter(string_split(body,chr(10)), lambda l: trim(l)<>'') END AS docs FROM raw_prescription_response), "
    "rd AS (SELECT delivery, rid, unnest(docs) AS doc, unnest(range(len(docs))) AS dn FROM rb), "
    "rr AS (SELECT delivery, rid, dn, coalesce(doc::JSON->'$.data.result', doc::JSON->'$.result') AS r FROM rd), "
    "rl AS (SELECT delivery, rid, dn, (CASE WHEN json_type(r)='VARCHAR' THEN (r->>'$')::JSON ELSE r END)->'$.layoutParsingResults' AS l FROM rr), "
    "re AS (SELECT delivery, rid, dn, CASE WHEN json_type(l)='ARRAY' THEN CAST(l AS JSON[]) WHEN json_type(l)='OBJECT' THEN [l] ELSE [] END AS ps FROM rl), "
    "ru AS (SELECT delivery, rid, dn, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM re), "
    "rp AS MATERIALIZED (SELECT delivery, rid, row_number() OVER (PARTITION BY delivery ORDER BY dn, i)-1 AS po, p, p->'$.prunedResult' AS pr FROM ru), "
    "rbl AS (SELECT delivery, rid, po, pr, unnest(CAST(pr->'$.parsing_res_list' AS JSON[])) AS b, unnest(range(CAST(json_array_length(pr->'$.parsing_res_list') AS BIGINT))) AS bo FROM rp WHERE json_type(pr->'$.parsing_res_list')='ARRAY'), "
    "rk AS MATERIALIZED (SELECT * FROM rbl WHERE json_type(b)='OBJECT')"
)
_INT = "CAST(trunc(TRY_CAST({} AS DOUBLE)) AS INTEGER)"
_W, _H = _INT.format("pr->>'$.width'"), _INT.format("pr->>'$.height'")
_RAW_BLOCKS = (
    RAW + f", o AS (SELECT rid, po, bo, b, coalesce({_INT.format('b->>' + chr(39) + '$.block_order' + chr(39))}, bo+1) AS reading_order, nullif({_W},0)::DOUBLE AS w, nullif({_H},0)::DOUBLE AS h, pr->'$.layout_det_res.boxes' AS boxes, [TRY_CAST(x->>'$' AS DOUBLE) FOR x IN CAST(b->'$.block_bbox' AS JSON[])] AS c FROM rk), "
    "q AS (SELECT *, coalesce(len(c),0)<4 AS few, greatest(0,least(c[1],w)) AS x1, greatest(0,least(c[2],h)) AS y1 FROM o), "
    "q2 AS (SELECT *, greatest(x1+1,least(c[3],w)) AS x2, greatest(y1+1,least(c[4],h)) AS y2 FROM q), "
    "q3 AS (SELECT *, round(x1/w*100,2) AS bx, round(y1/h*100,2) AS b_y, round((x2-x1)/w*100,2) AS bw, round((y2-y1)/h*100,2) AS bh FROM q2) "
    "SELECT DISTINCT 'raw_prescription_response' AS source_table, rid AS record_id, CAST(po AS INTEGER) AS page_ord, CAST(bo AS INTEGER) AS block_ord, CAST(po AS INTEGER) AS page_index, b->>'$.block_id' AS block_id, coalesce(b->>'$.block_label','text') AS block_type, coalesce(b->>'$.block_content','') AS content, CAST(reading_order AS INTEGER) AS reading_order, "
    "CASE WHEN json_type(boxes)='ARRAY' THEN round([TRY_CAST(z->>'$.score' AS DOUBLE) FOR z IN CAST(boxes AS JSON[]) IF TRY_CAST(z->>'$.order' AS DOUBLE)=reading_order][-1],4) END AS confidence, "
    "CASE WHEN few THEN 5 ELSE bx END AS bounding_box_x, CASE WHEN few THEN 5 ELSE b_y END AS bounding_box_y, CASE WHEN few THEN 90 WHEN bx+bw>100 THEN greatest(0.1,round(100-bx,2)) ELSE bw END AS bounding_box_w, CASE WHEN few THEN 10 WHEN b_y+bh>100 THEN greatest(0.1,round(100-b_y,2)) ELSE bh END AS bounding_box_h FROM q3"
)
_TYPED_BLOCKS = " UNION ALL ".join(f"SELECT DISTINCT source_table, rid AS record_id, CAST(po AS INTEGER) AS page_ord, CAST(bo AS INTEGER) AS block_ord, {_BLOCK_SQL} FROM ({_blocks_sql(n)}) WHERE b IS NOT NULL" for n in NESTED)
_TYPED_POINTS = " UNION ALL ".join(
    f"SELECT DISTINCT source_table, rid AS record_id, CAST(po AS INTEGER) AS page_ord, CAST(bo AS INTEGER) AS block_ord, CAST(qo AS INTEGER) AS point_ord, CAST(xo AS INTEGER) AS axis, v AS value FROM (SELECT source_table, rid, po, bo, qo, unnest(q) AS v, unnest(range(len(q))) AS xo FROM "
    f"(SELECT source_table, rid, po, bo, unnest(b.polygon) AS q, unnest(range(len(b.polygon))) AS qo FROM ({_blocks_sql(n)}))) WHERE v IS NOT NULL"
    for n in NESTED
)
SQL = {
    "p1_found": f"WITH {RAW} " + " UNION ".join(f"SELECT source_table, rid AS record_id, CAST(coalesce(p.page_index, po) AS INTEGER) AS page_index, b.block_id AS block_id FROM ({_blocks_sql(n)}) WHERE b IS NOT NULL" for n in NESTED)
    + " UNION SELECT 'raw_prescription_response', rid, CAST(po AS INTEGER), b->>'$.block_id' FROM rk",
    "p1_blocks": f"WITH raw AS (WITH {_RAW_BLOCKS}) {_TYPED_BLOCKS} UNION ALL SELECT * FROM raw",
    "p1_pages": f"WITH {RAW} " + " UNION ".join(f"SELECT '{n}' AS source_table, rid AS record_id, CAST(po AS INTEGER) AS page_ord, p.page_index AS page_index, p.width AS width, p.height AS height, p.tables_count AS tables_count, NULL::VARCHAR AS inputImage FROM ({_pages_sql(n)}) WHERE p IS NOT NULL" for n in NESTED)
    + f" UNION SELECT 'raw_prescription_response', rid, CAST(po AS INTEGER), NULL, {_W}, {_H}, NULL, p->>'$.inputImage' FROM rp WHERE json_type(p)='OBJECT'",
    "p1_runs": (
        f"WITH {RAW}, n AS (SELECT delivery, count(*) AS pages FROM rp GROUP BY delivery), k AS (SELECT delivery, count(*) AS blocks FROM rk GROUP BY delivery), "
        "d AS (SELECT rid, document_id, received_at, CASE WHEN docs IS NOT NULL THEN coalesce(pages,0) END AS pages, CASE WHEN docs IS NOT NULL THEN coalesce(blocks,0) END AS blocks FROM rb LEFT JOIN n USING (delivery) LEFT JOIN k USING (delivery)) "
        "SELECT DISTINCT 'payload' AS source_table, parsing_run.id AS record_id, parsing_run.document_id AS document_id, parsing_run.job_id AS job_id, parsing_run.provider_id AS provider_id, parsing_run.model_version AS model_version, "
        "parsing_run.page_count AS page_count, parsing_run.total_blocks AS total_blocks, parsing_run.execution_time_ms AS execution_time_ms FROM payload UNION ALL "
        "SELECT DISTINCT 'prescription_vl_result', result_id, document_id, metadata.parameters.cloud_job_id, metadata.provider_name, metadata.model_version, metadata.parameters.pages_parsed, total_blocks, execution_time_ms FROM prescription_vl_result UNION ALL "
        "SELECT 'raw_prescription_response', rid, arg_min(document_id, (received_at, document_id)) FILTER (WHERE document_id IS NOT NULL), NULL, NULL, NULL, CAST(max(pages) AS INTEGER), CAST(max(blocks) AS INTEGER), NULL FROM d GROUP BY rid"
    ),
    "p1_polygon_points": f"WITH {RAW}, g AS (SELECT rid, po, bo, unnest(CAST(b->'$.block_polygon_points' AS JSON[])) AS q, unnest(range(CAST(json_array_length(b->'$.block_polygon_points') AS BIGINT))) AS qo FROM rk WHERE json_type(b->'$.block_polygon_points')='ARRAY'), x AS (SELECT rid, po, bo, qo, unnest(CAST(q AS JSON[])) AS v, unnest(range(CAST(json_array_length(q) AS BIGINT))) AS xo FROM g WHERE json_type(q)='ARRAY') {_TYPED_POINTS} "
    "UNION ALL SELECT DISTINCT 'raw_prescription_response', rid, CAST(po AS INTEGER), CAST(bo AS INTEGER), CAST(qo AS INTEGER), CAST(xo AS INTEGER), TRY_CAST(v->>'$' AS DOUBLE) FROM x WHERE TRY_CAST(v->>'$' AS DOUBLE) IS NOT NULL",
}
QUERIES = {"p1_found": found, "p1_runs": runs, "p1_pages": pages, "p1_blocks": blocks, "p1_polygon_points": polygon_points}
