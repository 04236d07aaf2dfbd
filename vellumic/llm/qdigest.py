"""Percentiles of very large columns from mergeable q-digests (problem 2).

A value is quantized to one of ``2**BITS`` ordered cells (logarithmic, relative half-width ``ALPHA``,
mirrored for negative values). A digest is a set of rows ``(node, cnt)`` of the dyadic tree over the
cells: node 1 is the root, ``2 * i`` and ``2 * i + 1`` are the children of ``i``, leaf ``2**BITS + cell``.
Compression moves the counts of a node and its sibling to their parent while the three together stay
within ``floor(n / k)``; digests are merged by adding counts node by node and compressing again.

Error: a reported percentile is the representative of a cell whose rank is off by at most
``BITS * floor(n / k) <= eps * n`` rows, whatever the order of merging, as every summand obeys the
bound for its own n. The value itself is within a factor ``1 +- ALPHA`` of that cell's values; values
closer to zero than ``TINY`` count as zero and those beyond ``TINY * GAMMA ** HALF`` as that bound.

Defined results: null and NaN values are counted apart and are in no percentile; negative and infinite
readings are values like others; a null group is a group; ties share a cell; an empty group has no row.

Scale: each task makes digests of the rows it holds, and only these are shuffled, a row for each group and task; a
digest has at most about ``3 * k`` nodes however large or hot its group is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BITS = 16
ALPHA = 0.001
GAMMA = (1 + ALPHA) / (1 - ALPHA)
TINY = 1e-6
ZERO = 1 << (BITS - 1)
HALF = ZERO - 2


def cell_of(value: Column) -> Column:
    """The cell of a non-null, non-NaN double."""
    size = F.least(F.greatest(F.ceil(F.log(F.least(F.abs(value), F.lit(1e300)) / TINY) / math.log(GAMMA)), F.lit(0)), F.lit(HALF))
    return F.when(F.abs(value) <= TINY, F.lit(ZERO)).otherwise((F.lit(ZERO) + F.signum(value) * (size + 1)).cast("int")).cast("int")


def value_of(cell: Column) -> Column:
    """The representative of a cell: the point with the least relative error."""
    size = F.abs(cell - ZERO) - 1
    return F.when(cell == ZERO, F.lit(0.0)).otherwise(F.signum(cell - ZERO) * TINY * F.pow(F.lit(GAMMA), size) * (2 / (1 + GAMMA)))


def factor(eps: float) -> int:
    """The compression factor k for a rank error of eps * n."""
    if not 0 < eps < 1:
        raise ValueError("eps must lie between 0 and 1")
    return math.ceil(BITS / eps)


SPAN = BITS + 2


def compress_nodes(gid: np.ndarray, node: np.ndarray, cnt: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One bottom-up pass over the digests of many groups at once; nodes may repeat in the input."""
    limit = np.bincount(gid, weights=cnt).astype(np.int64) // k
    key, inverse = np.unique((gid.astype(np.int64) << SPAN) + node, return_inverse=True)
    cnt = np.bincount(inverse, weights=cnt, minlength=len(key)).astype(np.int64)
    node = key & ((1 << SPAN) - 1)
    level_of = np.frexp(node.astype(np.float64))[1] - 1
    done_key, done_cnt = [], []
    carry_key, carry_cnt = np.empty(0, np.int64), np.empty(0, np.int64)
    for level in range(BITS, -1, -1):
        own = level_of == level
        at, inverse = np.unique(np.concatenate([key[own], carry_key]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([cnt[own], carry_cnt]), minlength=len(at)).astype(np.int64)
        group, child = at >> SPAN, at & ((1 << SPAN) - 1)
        parent, pairing = np.unique((group << SPAN) + (child >> 1), return_inverse=True)
        pair = np.bincount(pairing, weights=n, minlength=len(parent)).astype(np.int64)
        where = np.minimum(np.searchsorted(key, parent), len(key) - 1)
        above = np.where(key[where] == parent, cnt[where], 0)
        up = (pair + above <= limit[parent >> SPAN]) & (level > 0)
        stay = ~up[pairing]
        done_key.append(at[stay])
        done_cnt.append(n[stay])
        carry_key, carry_cnt = parent[up], pair[up]
    key, cnt = np.concatenate(done_key), np.concatenate(done_cnt)
    key, cnt = key[cnt > 0], cnt[cnt > 0]
    return key >> SPAN, key & ((1 << SPAN) - 1), cnt


def _each_group(rows: DataFrame, group: Sequence[str], schema: T.StructType, work: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[np.ndarray]]], together: bool = False) -> DataFrame:
    """``work(gid, node, cnt) -> (gid, columns)`` over whole groups, many of them in one call.

    Rows are hash-partitioned and sorted by group (unless they are so already: ``together``), so that a batch holds whole groups but for its last
    one, which waits for the next batch; no more than one batch and one group are held at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)

        def emit(held: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
            gid = np.cumsum(start) - 1
            out_gid, columns = work(gid, held.column("node").to_numpy(), held.column("cnt").to_numpy())
            keys = held.select(list(group)).take(pa.array(np.flatnonzero(start)[out_gid]))
            table = pa.table([*keys.columns, *[pa.array(c) for c in columns]], names=target.names)
            yield from table.cast(target).to_batches()

        held: pa.Table | None = None
        for batch in batches:
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one])
            if held.num_rows == 0:
                continue
            start = _starts(held, group)
            last = int(np.flatnonzero(start)[-1])
            if last:
                yield from emit(held.slice(0, last), start[:last])
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from emit(held, _starts(held, group))

    if together:
        return rows.select(*group, "node", "cnt").mapInArrow(run, schema)
    order = [F.col(g).asc_nulls_first() for g in group]
    return rows.repartition(*group).sortWithinPartitions(*order).select(*group, "node", "cnt").mapInArrow(run, schema)


def _starts(table: pa.Table, group: Sequence[str]) -> np.ndarray:
    """True where a row's group differs from that of the row before it."""
    start = np.zeros(table.num_rows, bool)
    start[:1] = True
    for g in group:
        column = table.column(g).combine_chunks()
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        start[1:] |= codes[1:] != codes[:-1]
    return start


def _compressed(rows: DataFrame, group: Sequence[str], k: int, together: bool = False) -> DataFrame:
    schema = T.StructType([*[rows.schema[g] for g in group], T.StructField("node", T.LongType()), T.StructField("cnt", T.LongType())])

    def work(gid: np.ndarray, node: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        gid, node, cnt = compress_nodes(gid, node, cnt, k)
        return gid, [node, cnt]

    return _each_group(rows, group, schema, work, together)


def _local(rows: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Digests of what each task holds: one row per group with its nodes and counts as arrays, so that a shuffle carries each group's name once."""
    schema = T.StructType([*[rows.schema[g] for g in group], *[T.StructField(c, T.ArrayType(T.LongType())) for c in ("nodes", "cnts")]])
    keys = [*group, "node"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)

        def added(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by(keys).aggregate([("cnt", "sum")]).rename_columns([*keys, "cnt"])

        held: list[pa.Table] = []
        for batch in batches:
            one = pa.Table.from_batches([batch])
            held.append(one.append_column("cnt", pa.array(np.ones(one.num_rows, np.int64))))
            if sum(t.num_rows for t in held) > 2_000_000:
                held = [added(held)]
        total = added(held) if held else None
        if total is None or not total.num_rows:
            return
        total = total.sort_by([(g, "ascending") for g in group])
        start = _starts(total, group)
        gid, node, cnt = compress_nodes(np.cumsum(start) - 1, total.column("node").to_numpy(), total.column("cnt").to_numpy(), k)
        order = np.argsort(gid, kind="stable")
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(gid, minlength=int(start.sum())))], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (node, cnt)]
        names = total.select(list(group)).take(pa.array(np.flatnonzero(start)))
        yield from pa.table([*names.columns, *lists], names=target.names).cast(target).to_batches(max_chunksize=2000)

    return rows.select(*keys).mapInArrow(run, schema)


def build(df: DataFrame, group: Sequence[str], value: str, eps: float = 0.005) -> DataFrame:
    """Digest rows ``(*group, node, cnt)`` of a double column; null and NaN values are left out."""
    x = F.col(value)
    cells = df.where(x.isNotNull() & ~F.isnan(x)).select(*group, (cell_of(x) + (1 << BITS)).cast("long").alias("node"))
    parts = _local(cells, group, factor(eps)).repartition(*group).sortWithinPartitions(*[F.col(g).asc_nulls_first() for g in group])
    return _compressed(parts.select(*group, F.inline(F.arrays_zip(F.col("nodes").alias("node"), F.col("cnts").alias("cnt")))), group, factor(eps), together=True)


def merge(digests: DataFrame, group: Sequence[str], eps: float = 0.005) -> DataFrame:
    """Digests of coarser groups, or of the same groups from several inputs put together with ``union``."""
    added = digests.groupBy(*group, "node").agg(F.sum("cnt").alias("cnt"))
    return _compressed(added, group, factor(eps))


def quantiles(digests: DataFrame, group: Sequence[str], probabilities: Sequence[float], eps: float = 0.005) -> DataFrame:
    """One row per group: n, ``p50`` and so on, and the guaranteed rank error as a share of n."""
    names = {p: f"p{p * 100:g}".replace(".", "_") for p in probabilities}
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    # an ancestor's count may lie anywhere below it; in the order of right ends, deeper nodes first,
    # the running sum at a node is a lower bound of the rank of its right end
    schema = T.StructType([*[digests.schema[g] for g in group], T.StructField("n", T.LongType()), *[T.StructField(f"{c}_cell", T.IntegerType()) for c in names.values()]])

    def work(gid: np.ndarray, node: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        level = (np.frexp(node.astype(np.float64))[1] - 1).astype(np.int64)
        right = ((node + 1) << (BITS - level)) - 1 - (1 << BITS)
        order = np.lexsort((-level, right, gid))
        total = np.cumsum(cnt[order])
        n = np.bincount(gid, weights=cnt).astype(np.int64)
        base = np.cumsum(n) - n
        cells = [right[order][np.searchsorted(total, base + np.maximum(1, np.ceil(p * n - 1e-9)).astype(np.int64))] for p in names]
        return np.arange(len(n)), [n, *cells]

    rows = _each_group(digests, group, schema, work)
    k = factor(eps)
    bound = F.round(F.lit(float(BITS)) * F.floor(F.col("n") / k) / F.col("n"), 6).alias("rank_error")
    return rows.select(*group, "n", *[F.round(value_of(F.col(f"{c}_cell")), 6).alias(c) for c in names.values()], bound)
