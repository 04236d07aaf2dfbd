"""Boxes in percent of the page: structs of x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ALIGN, AlignConfig
from .text import edit_ratio, normalize


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def _inter(a: Column, b: Column, at: str, size: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))


def iou(a: Column, b: Column) -> Column:
    inter = _inter(a, b, "x", "w") * _inter(a, b, "y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - inter
    return F.when(union > 0, inter / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def vertical_center(a: Column) -> Column:
    return a["y"] + a["h"] / 2


def horizontal_overlap(a: Column, b: Column) -> Column:
    least = F.least(a["w"], b["w"])
    return F.when(least > 0, _inter(a, b, "x", "w") / F.nullif(least, F.lit(0.0))).otherwise(0.0)


def contains_center(outer: Column, inner: Column) -> Column:
    cx, cy = inner["x"] + inner["w"] / 2, inner["y"] + inner["h"] / 2
    return cx.between(outer["x"], outer["x"] + outer["w"]) & cy.between(outer["y"], outer["y"] + outer["h"])


def is_valid(a: Column) -> Column:
    """Inside the page, with an extent; a little rounding is let pass."""
    return F.coalesce(a["x"].between(0, 100) & a["y"].between(0, 100) & (a["w"] > 0) & (a["w"] <= 100) & (a["h"] > 0) & (a["h"] <= 100) & (a["x"] + a["w"] <= 100.001) & (a["y"] + a["h"] <= 100.001), F.lit(False))


def cost_of(overlap: Column, across: Column, apart: Column, block_order: Column, region_text: Column, block_text: Column, cfg: AlignConfig = ALIGN) -> Column:
    """Cost of a pair from its measures (IoU, horizontal overlap, distance of the centre lines); ``impossible`` for boxes that are clearly apart. Texts as by ``cost_text``."""
    order = F.when(F.coalesce(block_order, F.lit(0)) > 0, F.least(F.lit(1.0), block_order / cfg.order_reach)).otherwise(0.0)
    cost = cfg.w_iou * (1 - overlap) + cfg.w_vertical * apart / 100 + cfg.w_order * order + cfg.w_text * edit_ratio(region_text, block_text)
    return F.when((overlap < cfg.least_iou) & (across < cfg.least_overlap), F.lit(cfg.impossible)).otherwise(cost)


def pair_cost(region: Column, block: Column, region_text: Column, block_text: Column, block_order: Column, cfg: AlignConfig = ALIGN) -> Column:
    """Cost of matching a region with a block."""
    return cost_of(iou(region, block), horizontal_overlap(region, block), F.abs(vertical_center(region) - vertical_center(block)), block_order, region_text, block_text, cfg)


def cost_text(text: Column, cfg: AlignConfig = ALIGN) -> Column:
    """What the cost compares of a text; made once per region or block, before they are paired."""
    return F.substring(F.coalesce(normalize(text), F.lit("")), 1, cfg.text_chars)


def match_confidence(cost: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cost)), 4)


def _percent(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    left, top = F.greatest(F.lit(0.0), F.least(x1, width)), F.greatest(F.lit(0.0), F.least(y1, height))
    right, low = F.greatest(left + 1, F.least(x2, width)), F.greatest(top + 1, F.least(y2, height))
    x, y = F.round(left / width * 100, 2), F.round(top / height * 100, 2)
    w, h = F.round((right - left) / width * 100, 2), F.round((low - top) / height * 100, 2)
    return box(x, y, F.when(x + w > 100, F.greatest(F.lit(0.1), F.round(100 - x, 2))).otherwise(w), F.when(y + h > 100, F.greatest(F.lit(0.1), F.round(100 - y, 2))).otherwise(h))


def from_polygon(polygon: Column, width: Column, height: Column) -> Column:
    """The box around a polygon in pixels; fewer than three points give a default box."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    around = _percent(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), width.cast("double"), height.cast("double"))
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) < 3, box(F.lit(5), F.lit(5), F.lit(90), F.lit(10))).otherwise(around)


def from_corners(corners: Column, width: Column, height: Column) -> Column:
    """The box of [x1, y1, x2, y2] in pixels."""
    c = [F.get(corners, i).cast("double") for i in range(4)]
    return F.when(F.coalesce(F.size(corners), F.lit(0)) < 4, box(F.lit(5), F.lit(5), F.lit(90), F.lit(10))).otherwise(_percent(*c, width.cast("double"), height.cast("double")))


def crop_pixels(a: Column, width: Column, height: Column) -> Column:
    """The pixels of a box: at least one, moved into the page."""
    w, h = F.greatest(F.lit(1), (a["w"] / 100 * width).cast("int")), F.greatest(F.lit(1), (a["h"] / 100 * height).cast("int"))
    left, top = (a["x"] / 100 * width).cast("int"), (a["y"] / 100 * height).cast("int")
    return F.struct(F.greatest(F.lit(0), F.least(left, width - w)).alias("left"), F.greatest(F.lit(0), F.least(top, height - h)).alias("top"), w.alias("width"), h.alias("height"))


def padded(a: Column, width: Column, height: Column, pixels: int = 4) -> Column:
    """The box with a margin, cut at the page."""
    px, py = pixels * 100.0 / width, pixels * 100.0 / height
    x, y = F.greatest(F.lit(0.0), a["x"] - px), F.greatest(F.lit(0.0), a["y"] - py)
    return box(x, y, F.least(F.lit(100.0), a["x"] + a["w"] + px) - x, F.least(F.lit(100.0), a["y"] + a["h"] + py) - y)
