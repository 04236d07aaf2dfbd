"""Recognition results as JSON lines turned into regions, pages and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

OCR = "result struct<ocrResults array<struct<prunedResult struct<rec_texts array<string>,rec_scores array<double>,dt_polys array<array<array<double>>>>>>>"
LAYOUT = (
    "result struct<layoutParsingResults array<struct<prunedResult struct<width int,height int,layout_det_res struct<boxes array<struct<`order` int,score double>>>,"
    "parsing_res_list array<struct<block_id string,block_label string,block_order int,block_bbox array<double>,block_polygon_points array<array<double>>,block_content string>>>,markdown struct<text string>>>>"
)


def ocr_regions(lines: DataFrame, body: str = "body", line_no: str = "line_no", keys: list[str] | None = None, least: float = 0.30) -> DataFrame:
    """One row per recognised line; pages run on over the lines of a document. Blank texts are dropped, weak ones illegible."""
    keys = keys or ["doc"]
    page = lines.select(*keys, line_no, F.posexplode(F.from_json(body, OCR)["result"]["ocrResults"]).alias("_p", "page_json"))
    page = page.withColumn("page_index", (F.row_number().over(Window.partitionBy(*keys).orderBy(line_no, "_p")) - 1).cast("int"))
    r = F.col("page_json.prunedResult")
    zipped = F.arrays_zip(r["rec_texts"].alias("text"), r["rec_scores"].alias("score"), r["dt_polys"].alias("polygon"))
    least_size = F.least(F.size(r["rec_texts"]), F.size(r["rec_scores"]), F.size(r["dt_polys"]))
    rows = page.select(*keys, "page_index", F.posexplode(F.slice(zipped, F.lit(1), F.greatest(least_size, F.lit(0)))).alias("idx", "z"))
    rows = rows.select(*keys, "page_index", "idx", F.trim("z.text").alias("text"), F.round("z.score", 4).alias("confidence"), F.col("z.polygon").alias("polygon")).where(F.col("text") != "")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("page_index", "idx"))
    return rows.withColumns({"ordinal": n.cast("int"), "is_illegible": F.col("confidence") < least}).withColumn("region_id", F.format_string("reg-p%d-%03d", F.col("page_index"), F.col("ordinal")))


def _score(boxes: Column, order: Column) -> Column:
    """The score of the last box with that order."""
    hits = F.filter(boxes, lambda b: b["order"] == order)
    return F.round(F.try_element_at(hits, F.lit(-1))["score"], 4)


def layout_pages(lines: DataFrame, body: str = "body", line_no: str = "line_no", keys: list[str] | None = None) -> DataFrame:
    """One row per page with its blocks in reading order, the provider's order kept beside, and the tables counted."""
    keys = keys or ["doc"]
    page = lines.select(*keys, line_no, F.posexplode(F.from_json(body, LAYOUT)["result"]["layoutParsingResults"]).alias("_p", "j"))
    page = page.withColumn("page_index", (F.row_number().over(Window.partitionBy(*keys).orderBy(line_no, "_p")) - 1).cast("int"))
    r = F.col("j.prunedResult")
    boxes = F.coalesce(r["layout_det_res"]["boxes"], F.array().cast("array<struct<`order`:int,score:double>>"))

    def block(b: Column, i: Column) -> Column:
        order = F.coalesce(b.block_order, (i + 1).cast("int"))
        return F.struct(
            order.alias("reading_order"), i.cast("int").alias("pos"), F.coalesce(b.block_id, i.cast("string")).alias("block_id"), F.coalesce(b.block_label, F.lit("text")).alias("block_type"),
            F.coalesce(b.block_content, F.lit("")).alias("content"), G.from_corners(b.block_bbox, r["width"], r["height"]).alias("bounding_box"), _score(boxes, order).alias("confidence"),
        )

    blocks = F.transform(F.coalesce(r["parsing_res_list"], F.array().cast("array<struct<block_id:string,block_label:string,block_order:int,block_bbox:array<double>,block_polygon_points:array<array<double>>,block_content:string>>")), block)
    out = page.select(*keys, "page_index", r["width"].alias("width"), r["height"].alias("height"), F.col("j.markdown.text").alias("markdown_text"), blocks.alias("given"))
    return out.select(
        *keys, "page_index", "width", "height", "markdown_text", F.array_sort("given").alias("blocks"), F.transform("given", lambda b: b.block_id).alias("reading_order_sequence"),
        F.size("given").alias("blocks_count"), F.size(F.filter("given", lambda b: F.lower(b.block_type).contains("table"))).alias("tables_count"),
    )
