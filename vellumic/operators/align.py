"""Regions matched with layout blocks of the same page.

``regions``: doc, page, region (ordinal), box, text. ``blocks``: doc, page, block (ordinal), box, text,
reading_order. Both sides of a page meet in one row by a single shuffle; the pairs of a page are made from
it in the JVM and stay together, so that matching needs neither a join nor another shuffle or sort.

Defined results: a null page or document is a page or document of its own; without boxes the cost is null,
which no match may have; a page with one side only leaves all of it unmatched; other columns are ignored.
A page is one unit of work: its pairs must fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import ALIGN, AlignConfig
from ..functions import geometry as G
from .grouped import whole_runs

PAGE = ["doc", "page"]
STATUS = ["one_to_one", "one_to_many", "unmatched_region", "unmatched_block"]


def pages(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """One row per page: its regions and its blocks as arrays in the order of their ordinals."""
    text = G.cost_text(F.col("text"), cfg).alias("text")  # normalized once, before texts are paired
    r = regions.select(*PAGE, F.struct("region", "box", text).alias("r"))
    b = blocks.select(*PAGE, F.struct("block", "box", text, "reading_order").alias("b"))
    both = r.unionByName(b, allowMissingColumns=True)
    return both.groupBy(*PAGE).agg(F.array_sort(F.collect_list("r")).alias("rs"), F.array_sort(F.collect_list("b")).alias("bs"))


def _pairs(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig, outer: bool) -> DataFrame:
    """All pairs of each page, those of one page one after another; ``outer`` keeps pages of one side."""
    each = F.posexplode_outer if outer else F.posexplode
    page = pages(regions, blocks, cfg).withColumn("_page", F.monotonically_increasing_id())
    both = page.select(*PAGE, "_page", "bs", each("rs").alias("_r", "r")).select(*PAGE, "_page", "_r", "r", each("bs").alias("_b", "b"))
    there = F.col("_r").isNotNull() & F.col("_b").isNotNull()
    r, t = F.col("r.box"), F.col("b.box")
    inside = F.coalesce(G.contains_center(t, r), F.lit(False))
    places = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("_r", "_b")]
    # measures first, each once: one long expression would be too large a method for the JVM to compile
    measured = both.select(
        *PAGE, "_page", *places, F.col("r.region").alias("region"), F.col("b.block").alias("block"), F.when(there, G.iou(r, t)).alias("iou"), inside.alias("inside"), G.horizontal_overlap(r, t).alias("_over"),
        F.abs(G.vertical_center(r) - G.vertical_center(t)).alias("_apart"), F.col("r.text").alias("_rt"), F.col("b.text").alias("_bt"), F.col("b.reading_order").alias("_order"),
    )
    cost = G.cost_of(F.col("iou"), F.col("_over"), F.col("_apart"), F.col("_order"), F.col("_rt"), F.col("_bt"), cfg)
    return measured.select(*PAGE, "_page", "_r", "_b", "region", "block", F.when(F.col("iou").isNotNull(), cost).alias("cost"), "iou", "inside")


def cost_pairs(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """Every region and block of a page with their cost and IoU."""
    return _pairs(regions, blocks, cfg, False).select(*PAGE, "region", "block", "cost", "iou")


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """A cheapest complete matching of the smaller side, by shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        return [(i, j) for j, i in hungarian(cost.T)]
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner, came = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            slack = cost[owner[j] - 1] - row_price[owner[j]] - col_price[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], j
            open_ = np.where(used[1:], np.inf, least[1:])
            nxt = int(np.argmin(open_)) + 1
            step = open_[nxt - 1]
            row_price[owner[used]] += step
            col_price[used] -= step
            least[~used] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[came[j]]
            j = came[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def greedy(pairs: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Pairs by cost (ties in their order), each taken while both sides are free."""
    rows, cols, out = set(), set(), []
    for i, j, _ in sorted(pairs, key=lambda p: p[2]):
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append((i, j))
    return out


def _assigned(table: np.ndarray, cfg: AlignConfig, optimal: bool) -> list[int]:
    """Places of a page's cost table, row by row, that are assigned and cheap enough."""
    n, m = table.shape
    if optimal and n <= m and len(set(best := table.argmin(axis=1).tolist())) == n:
        found = enumerate(best)  # each row has its cheapest: nothing is cheaper
    elif optimal and m < n and len(set(best := table.argmin(axis=0).tolist())) == m:
        found = [(i, j) for j, i in enumerate(best)]
    else:
        found = hungarian(table) if optimal else greedy([(i, j, table[i, j]) for i in range(n) for j in range(m)])
    return [i * m + j for i, j in found if table[i, j] <= cfg.most_cost]


class _Pages:
    """A batch of whole pages: the columns of their pairs, and numbers for their regions and blocks."""

    def __init__(self, table: pa.Table, cfg: AlignConfig):
        get = lambda c: table.column(c).to_numpy()
        page, r, b = get("_page"), get("_r"), get("_b")
        self.cost, self.iou, self.inside = get("cost"), get("iou"), get("inside")
        self.cost = np.where(np.isnan(self.cost), cfg.impossible, self.cost)
        self.has_region, self.has_block = r >= 0, b >= 0
        bounds = np.flatnonzero(np.r_[True, page[1:] != page[:-1], True])
        self.low, self.size = bounds[:-1], np.diff(bounds)
        self.blocks = b[bounds[1:] - 1].clip(0) + 1  # of each page
        regions = self.size // self.blocks
        first = lambda n: np.repeat(np.cumsum(n) - n, self.size)
        self.region, self.block = first(regions) + r.clip(0), first(self.blocks) + b.clip(0)
        self.n_regions, self.n_blocks = int(regions.sum()), int(self.blocks.sum())

    def assigned(self, cfg: AlignConfig, optimal: bool) -> np.ndarray:
        out: list[int] = []
        for low, size, blocks, whole in zip(self.low.tolist(), self.size.tolist(), self.blocks.tolist(), (self.has_region & self.has_block)[self.low].tolist()):
            if whole:
                out += [low + i for i in _assigned(self.cost[low : low + size].reshape(-1, blocks), cfg, optimal)]
        return np.array(out, np.int64)

    def left_over(self, used_r: np.ndarray, used_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A pair of each region and of each block that is not used."""
        free_r, free_b = (np.unique(c, return_index=True)[1] for c in (self.region, self.block))
        return free_r[self.has_region[free_r] & ~used_r[self.region[free_r]]], free_b[self.has_block[free_b] & ~used_b[self.block[free_b]]]


def _each_batch(pairs: DataFrame, fields: list[T.StructField], cfg: AlignConfig, work: Callable[[_Pages], tuple[np.ndarray, dict[str, np.ndarray]]]) -> DataFrame:
    """``work`` says which pairs of a batch of pages stay, and gives the values of further columns."""
    schema = T.StructType([*[pairs.schema[c] for c in (*PAGE, "region", "block")], *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for table in whole_runs(batches, "_page"):
            keep, more = work(_Pages(table, cfg))
            picked = table.select([*PAGE, "region", "block"]).take(pa.array(keep))
            columns = dict(zip(picked.column_names, picked.columns)) | {n: pa.array(v, target.field(n).type, from_pandas=True) for n, v in more.items()}
            if "status" in columns:  # a pair stands for what is left over of one of its sides
                for name, gone in (("region", "unmatched_block"), ("block", "unmatched_region")):
                    columns[name] = pc.if_else(pa.array(more["status"] != gone, pa.bool_()), columns[name], pa.scalar(None, columns[name].type))
            yield from pa.table([columns[n] for n in target.names], names=target.names).cast(target).to_batches()

    return pairs.mapInArrow(run, schema)


def _assign(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig, optimal: bool) -> DataFrame:
    def work(page: _Pages) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        keep = page.assigned(cfg, optimal)
        return keep, {"cost": page.cost[keep]}

    return _each_batch(_pairs(regions, blocks, cfg, False), [T.StructField("cost", T.DoubleType())], cfg, work)


def assign_optimal(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """One-to-one pairs of least total cost per page; pairs that cost too much are dropped afterwards."""
    return _assign(regions, blocks, cfg, True)


def assign_greedy(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """Pairs by cost, each taken while both sides are free."""
    return _assign(regions, blocks, cfg, False)


def unfit(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """``doc, page, id, side``: regions for which no block of their page is cheap enough, and blocks for which no region is.

    Both sides are told from one pass over the pairs. On a null page or document nothing fits.
    """

    def work(page: _Pages) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        fit = page.cost <= cfg.most_cost
        used_r, used_b = ~np.ones(page.n_regions, bool), ~np.ones(page.n_blocks, bool)
        used_r[page.region[fit]], used_b[page.block[fit]] = True, True
        parts = page.left_over(used_r, used_b)
        return np.concatenate(parts), {"status": np.repeat(np.array(STATUS[2:], object), [len(p) for p in parts])}

    pairs = _pairs(regions, blocks, cfg, True).withColumn("cost", F.when(F.col("doc").isNotNull() & F.col("page").isNotNull(), F.col("cost")))
    rows = _each_batch(pairs, [T.StructField("status", T.StringType())], cfg, work)
    return rows.select(*PAGE, F.coalesce("region", "block").alias("id"), F.replace("status", F.lit("unmatched_"), F.lit("")).alias("side"))


def contained(regions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each region with the first block that holds its centre."""
    each = pages(regions, blocks).select(*PAGE, "bs", F.explode("rs").alias("r"))
    first = F.get(F.filter("bs", lambda b: G.contains_center(b["box"], F.col("r.box"))), F.lit(0))["block"]
    return each.select(*PAGE, F.col("r.region").alias("region"), first.alias("block")).where(F.col("block").isNotNull())


def align(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """One-to-one matches, then regions by containment in blocks that are still free, and what is left on either side.

    ``iou`` is that of the matched boxes, for both kinds of match; unmatched rows have none.
    """
    fields = [T.StructField("status", T.StringType()), T.StructField("iou", T.DoubleType()), T.StructField("cost", T.DoubleType())]

    def work(page: _Pages) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        one = page.assigned(cfg, True)
        used_r, used_b = ~np.ones(page.n_regions, bool), ~np.ones(page.n_blocks, bool)
        used_r[page.region[one]], used_b[page.block[one]] = True, True
        rest = np.flatnonzero(page.inside & ~used_r[page.region] & ~used_b[page.block])
        many = rest[np.unique(page.region[rest], return_index=True)[1]]  # the first block that holds a region
        used_r[page.region[many]], used_b[page.block[many]] = True, True
        free_r, free_b = page.left_over(used_r, used_b)
        parts = [one, many, free_r, free_b]
        none = np.full(len(free_r) + len(free_b), np.nan)
        status = np.repeat(np.array(STATUS, object), [len(p) for p in parts])
        return np.concatenate(parts), {"status": status, "iou": np.r_[page.iou[one], page.iou[many], none], "cost": np.r_[page.cost[one], np.full(len(many), np.nan), none]}

    rows = _each_batch(_pairs(regions, blocks, cfg, True), fields, cfg, work)
    return rows.select(*PAGE, "region", "block", "status", F.round("iou", 4).alias("iou"), confidence(F.col("status"), F.col("cost"), cfg).alias("confidence"))


def confidence(status: Column, cost: Column, cfg: AlignConfig = ALIGN) -> Column:
    return F.when(status == "one_to_one", G.match_confidence(cost)).when(status == "one_to_many", F.lit(cfg.containment_confidence)).otherwise(0.0)


def matched(regions: DataFrame, blocks: DataFrame, cfg: AlignConfig = ALIGN) -> DataFrame:
    """The regions of ``align`` that have a block."""
    return align(regions, blocks, cfg).where(F.col("status").isin("one_to_one", "one_to_many"))


def latest_by(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows per key in an order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
