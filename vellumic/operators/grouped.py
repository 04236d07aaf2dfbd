"""Runs of rows over Arrow batches: rows that belong together come one after another."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows in tables that hold whole runs of equal, non-null values of an integer column.

    A run that goes on over many batches is put together once, when it ends.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        run = batch.column(column).to_numpy()
        if held and held[-1].column(column)[-1].as_py() != run[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[-1])
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
