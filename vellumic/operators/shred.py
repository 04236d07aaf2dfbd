"""Columnar shredding of nested records into level sequences, and flat tables rebuilt from them.

Every leaf of a nested type becomes one column of three sequences: repetition levels, definition
levels and the defined values. An optional field adds one definition level; a list adds one
for "the list is there", one for "it has an element", and its element, being optional, a third.
A repetition level says which list of the path has started a new element (0: a new record).

``shred``     DataFrame -> one row per record, three arrays per leaf (lossless).
``assemble``  shredded DataFrame -> the table of one repeated ancestor, with the ordinals of all
              lists on the way (the parent-child link) and any leaves of the ancestor or above it.
``flatten``   both steps on each Arrow batch, for queries that need no stored shreds.

All steps work on whole Arrow batches with numpy; no shuffle takes place and a record never leaves
its task. Defined results: a null record, null list or empty list gives no row; a null element gives
no row unless ``keep_null_elements``; null leaves stay null; an extra column of the input that is no
key is ignored, so names can not clash; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Levels:
    """A leaf column of a batch of records."""

    rep: np.ndarray
    dfn: np.ndarray
    values: pa.Array  # where dfn == max_def
    max_def: int


@dataclass(frozen=True)
class Step:
    """One step of a path: a field of a struct, or the elements of a list."""

    name: str  # "" for a list's elements
    dfn: int  # definition level from which on the thing is there
    rep: int  # lists passed so far, this one included


def steps_of(kind: pa.DataType, path: str) -> list[Step]:
    """The steps from a record column of type ``kind`` to a dotted path; lists are entered as they come."""
    out: list[Step] = []
    dfn, rep = 1, 0
    for name in [p for p in path.split(".") if p]:
        while pa.types.is_list(kind) or pa.types.is_large_list(kind):
            dfn, rep, kind = dfn + 2, rep + 1, kind.value_type
            out.append(Step("", dfn, rep))
        index = kind.get_field_index(name) if pa.types.is_struct(kind) else -1
        if index < 0:
            raise KeyError(f"no field {name!r} on the way to {path!r}")
        kind, dfn = kind.field(index).type, dfn + 1
        out.append(Step(name, dfn, rep))
    while pa.types.is_list(kind) or pa.types.is_large_list(kind):
        dfn, rep, kind = dfn + 2, rep + 1, kind.value_type
        out.append(Step("", dfn, rep))
    return out


def leaf_type(kind: pa.DataType, path: str) -> pa.DataType:
    for name in [*[p for p in path.split(".") if p], None]:
        while pa.types.is_list(kind) or pa.types.is_large_list(kind):
            kind = kind.value_type
        if name is not None:
            kind = kind.field(kind.get_field_index(name)).type
    return kind


def leaf_paths(kind: pa.DataType, at: str = "") -> list[str]:
    """All leaves below a type, as dotted paths."""
    while pa.types.is_list(kind) or pa.types.is_large_list(kind):
        kind = kind.value_type
    if not pa.types.is_struct(kind):
        return [at]
    return [p for i in range(kind.num_fields) for p in leaf_paths(kind.field(i).type, f"{at}.{kind.field(i).name}".strip("."))]


def levels(column: pa.Array, path: str) -> Levels:
    """Level sequences of one leaf over a batch: each step either ends an entry or descends it."""
    n = len(column)
    rep, dfn, at = np.zeros(n, np.int8), np.zeros(n, np.int8), np.arange(n)
    array = column

    def keep_valid(at: np.ndarray, dfn: np.ndarray, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if array.null_count and len(array):
            valid = np.asarray(array.is_valid())
            at = np.where((at >= 0) & valid[np.maximum(at, 0)], at, -1)
        return at, dfn + (at >= 0).astype(np.int8)

    at, dfn = keep_valid(at, dfn, array)
    for step in steps_of(column.type, path):
        if step.name:
            array = array.field(array.type.get_field_index(step.name))
            at, dfn = keep_valid(at, dfn, array)
            continue
        # a list that is there: one entry per element, or one that ends here when it is empty
        offsets = np.asarray(array.offsets)
        array = array.values
        live = at >= 0
        i = np.where(live, at, 0)
        begin = np.where(live, offsets[i] if len(offsets) > 1 else 0, 0)
        size = np.where(live, offsets[i + 1] - offsets[i] if len(offsets) > 1 else 0, 0)
        times = np.maximum(size, 1)
        first = np.cumsum(times) - times
        source = np.repeat(np.arange(len(at)), times)
        offset = np.arange(len(source)) - first[source]
        has = size[source] > 0
        rep = np.where(offset > 0, step.rep, rep[source]).astype(np.int8)
        dfn = (dfn[source] + has).astype(np.int8)
        at = np.where(has, begin[source] + offset, -1)
        at, dfn = keep_valid(at, dfn, array)
    there = at[at >= 0]
    last = steps_of(column.type, path)
    return Levels(rep, dfn, array.take(pa.array(there, pa.int64())), last[-1].dfn if last else 1)


def ordinals(rep: np.ndarray, level: int) -> np.ndarray:
    """0-based position of each entry's element in its list at a repetition level."""
    started = np.cumsum(rep <= level)
    base = np.maximum.accumulate(np.where(rep < level, started, 0))
    return started - base


def values_of(lv: Levels) -> pa.Array:
    """One value or null per entry."""
    defined = lv.dfn == lv.max_def
    index = np.cumsum(defined) - 1
    return lv.values.take(pa.array(index, pa.int64(), mask=~defined))


def below(ancestor: str, path: str) -> bool:
    return not ancestor or path == ancestor or path.startswith(ancestor + ".")


def _enters(kind: pa.DataType, ancestor: str) -> list[Step]:
    lists = [s for s in steps_of(kind, ancestor) if not s.name]
    if not lists:
        raise ValueError(f"{ancestor!r} is not repeated")
    return lists


def rebuild(kind: pa.DataType, ancestor: str, columns: dict[str, Levels], keep_null_elements: bool = False) -> tuple[np.ndarray, list[np.ndarray], dict[str, pa.Array]]:
    """Rows of the table at a repeated ancestor: record index, the ordinal of each list, and the leaves' values.

    ``columns`` are levels of leaves; at least one lies below the ancestor. A leaf of an outer level
    is looked up by the running number of the outer element that the entry belongs to.
    """
    lists = _enters(kind, ancestor)
    depth = len(lists)
    own = [p for p in columns if below(ancestor, p)]
    guide = min(own, key=lambda p: len(_enters(kind, p)))
    lv = columns[guide]
    starts = lv.rep <= depth  # deeper repetitions belong to the same element
    there = starts & (lv.dfn >= (lists[-1].dfn - (1 if keep_null_elements else 0)))
    rep = lv.rep[starts]
    keep = there[starts]
    record = np.cumsum(rep == 0) - 1
    ords = [ordinals(rep, k)[keep] for k in range(1, depth + 1)]
    out: dict[str, pa.Array] = {}
    for path, other in columns.items():
        inner = len([s for s in steps_of(kind, path) if not s.name])
        if inner > depth:
            continue
        value = values_of(other)
        running = np.cumsum(rep <= inner) - 1 if inner < depth else np.arange(len(rep))
        out[path] = value.take(pa.array(running[keep], pa.int64()))
    return record[keep], ords, out


def _spark_leaf(kind: T.DataType, path: str) -> T.DataType:
    for name in [*[p for p in path.split(".") if p], None]:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if name is not None:
            kind = kind[name].dataType
    return kind


def _array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def column_name(path: str) -> str:
    return path.replace(".", "__") or "value"


def shred(df: DataFrame, keys: list[str], column: str, paths: list[str] | None = None) -> DataFrame:
    """One row per record: the keys and, per leaf, ``<leaf>__rep``, ``<leaf>__def`` and ``<leaf>__val``."""
    kind = df.schema[column].dataType
    arrow_kind = to_arrow_schema(T.StructType([df.schema[column]])).field(0).type
    paths = paths or leaf_paths(arrow_kind)
    fields = [df.schema[k] for k in keys]
    for p in paths:
        leaf = _spark_leaf(kind, p)
        fields += [T.StructField(f"{column_name(p)}__{part}", T.ArrayType(t)) for part, t in (("rep", T.ByteType()), ("def", T.ByteType()), ("val", leaf))]
    schema = T.StructType(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            arrays = [batch.column(k) for k in keys]
            for p in paths:
                lv = levels(_array(batch.column(column)), p)
                bounds = np.append(np.flatnonzero(lv.rep == 0), len(lv.rep)).astype(np.int32)
                defined = np.append(0, np.cumsum(lv.dfn == lv.max_def)).astype(np.int32)
                arrays += [
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(lv.rep)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(lv.dfn)),
                    pa.ListArray.from_arrays(pa.array(defined[bounds]), lv.values),
                ]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)

    return df.select(*keys, column).mapInArrow(run, schema)


def _table_schema(key_fields: list[T.StructField], kind: T.DataType, arrow_kind: pa.DataType, ancestor: str, leaves: dict[str, str]) -> T.StructType:
    depth = len(_enters(arrow_kind, ancestor))
    inner = [p for p in leaves if len([s for s in steps_of(arrow_kind, p) if not s.name]) > depth]
    if inner:
        raise ValueError(f"leaves below a further list: {inner}")
    return T.StructType([*key_fields, *[T.StructField(f"ord_{k}", T.IntegerType()) for k in range(1, depth + 1)], *[T.StructField(name, _spark_leaf(kind, p)) for p, name in leaves.items()]])


def _rows(batch_keys: list[pa.Array], kind: pa.DataType, ancestor: str, leaves: dict[str, str], columns: dict[str, Levels], target: pa.Schema, keep_null: bool) -> pa.RecordBatch:
    record, ords, values = rebuild(kind, ancestor, columns, keep_null)
    take = pa.array(record, pa.int64())
    arrays = [k.take(take) for k in batch_keys] + [pa.array(o, pa.int32()) for o in ords] + [values[p] for p in leaves]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)


def _guide(kind: pa.DataType, ancestor: str, leaves: Iterable[str]) -> str:
    """A leaf that shows which elements of the ancestor are there."""
    own = [p for p in leaves if below(ancestor, p)]
    if own:
        return own[0]
    for name in [p for p in ancestor.split(".") if p]:
        while pa.types.is_list(kind) or pa.types.is_large_list(kind):
            kind = kind.value_type
        kind = kind.field(kind.get_field_index(name)).type
    nearest = min(leaf_paths(kind), key=lambda p: p.count("."))
    return f"{ancestor}.{nearest}".strip(".") if nearest else ancestor


def flatten(df: DataFrame, keys: list[str], column: str, ancestor: str, leaves: dict[str, str], keep_null_elements: bool = False) -> DataFrame:
    """The table of one repeated ancestor of a nested column: keys, ``ord_1..n`` and the leaves under their new names."""
    kind = df.schema[column].dataType
    arrow_kind = to_arrow_schema(T.StructType([df.schema[column]])).field(0).type
    schema = _table_schema([df.schema[k] for k in keys], kind, arrow_kind, ancestor, leaves)
    guide = _guide(arrow_kind, ancestor, leaves)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            nested = _array(batch.column(column))
            columns = {p: levels(nested, p) for p in dict.fromkeys([*leaves, guide])}
            yield _rows([batch.column(k) for k in keys], nested.type, ancestor, leaves, columns, target, keep_null_elements)

    return df.select(*keys, column).mapInArrow(run, schema)


def assemble(shredded: DataFrame, keys: list[str], kind: T.DataType, ancestor: str, leaves: dict[str, str], keep_null_elements: bool = False) -> DataFrame:
    """As ``flatten``, from stored level sequences; ``kind`` is the type of the column that was shredded."""
    arrow_kind = to_arrow_schema(T.StructType([T.StructField("c", kind)])).field(0).type
    schema = _table_schema([shredded.schema[k] for k in keys], kind, arrow_kind, ancestor, leaves)
    stored = {c[: -len("__rep")] for c in shredded.columns if c.endswith("__rep")}
    guide = next((p for p in [*leaves, *leaf_paths(arrow_kind)] if below(ancestor, p) and column_name(p) in stored), None)
    if guide is None:
        raise ValueError(f"no shredded leaf lies below {ancestor!r}")
    paths = list(dict.fromkeys([*leaves, guide]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            columns = {}
            for p in paths:
                rep, dfn, val = (_array(batch.column(f"{column_name(p)}__{part}")).flatten() for part in ("rep", "def", "val"))
                st = steps_of(arrow_kind, p)
                columns[p] = Levels(np.asarray(rep), np.asarray(dfn), val, st[-1].dfn if st else 1)
            yield _rows([batch.column(k) for k in keys], arrow_kind, ancestor, leaves, columns, target, keep_null_elements)

    return shredded.select(*keys, *[f"{column_name(p)}__{part}" for p in paths for part in ("rep", "def", "val")]).mapInArrow(run, schema)
