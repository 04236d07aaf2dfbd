"""Recognition by any provider: a callable over batches of contents, run where the contents lie."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Reading = tuple[str | None, float | None]
SCHEMA = "text string, confidence double, error string"


def recognise(df: DataFrame, content: str, provider: Callable[[], Callable[[Sequence[bytes]], Sequence[Reading]]], batch: int = 16) -> DataFrame:
    """The table without its contents, with the reading of each: text, confidence, error.

    ``provider()`` is called once per task, for instance to load a model; what it returns reads ``batch`` contents at a time.
    A batch that fails gives its rows the error and no reading; a null content is not read.
    """
    kept = [c for c in df.columns if c != content]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != content]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = provider()
        for all_rows in batches:
            for at in range(0, all_rows.num_rows, batch):
                part = all_rows.slice(at, batch)
                given = part.column(content).to_pylist()
                out: list[tuple] = [(None, None, None)] * len(given)
                there = [i for i, x in enumerate(given) if x is not None]
                try:
                    for i, (text, confidence) in zip(there, read([given[i] for i in there]), strict=True) if there else ():
                        out[i] = (text, confidence, None)
                except Exception as e:  # a provider's failure is data
                    for i in there:
                        out[i] = (None, None, f"{type(e).__name__}: {e}")
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.float64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *columns], names=[*kept, "text", "confidence", "error"])

    return df.mapInArrow(run, ", ".join([*fields, SCHEMA]))
