"""The seam where contents become text: any reader that takes a batch of contents
and gives as many texts, run over the rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Reader = Callable[[list[bytes]], list[str]]

#: Contents of one call, and rows and bytes that a worker holds.
BATCH = 8


def attempts(reader: Reader, contents: list[bytes], batch: int) -> Iterator[tuple[str | None, str | None]]:
    """(text, error) of every content.  A call that fails is tried again by halves,
    down to single contents; one that fails alone is an error of its own."""
    for k in range(0, len(contents), batch):
        todo = [contents[k : k + batch]]
        while todo:
            some = todo.pop()
            try:
                texts = reader(some)
                if len(texts) != len(some):
                    raise ValueError(f"{len(texts)} texts for {len(some)} contents")
                yield from ((t, None) for t in texts)
            except Exception as e:  # noqa: BLE001  a reader may fail in any way
                if len(some) == 1:
                    yield None, f"{type(e).__name__}: {e}"
                else:
                    half = (len(some) + 1) // 2
                    todo += [some[half:], some[:half]]


def read(df: DataFrame, key: list[str], content: str, made: Callable[[], Reader], batch: int = BATCH) -> DataFrame:
    """(key, text, error) of every row.  ``made`` builds the reader, once a task; a null
    content has neither text nor error."""
    schema = df.select(*key).schema.add("text", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for b in batches:
            reader = reader or made()
            held = b.column(b.num_columns - 1).to_pylist()
            there = [c for c in held if c is not None]
            told = attempts(reader, there, batch)
            both = [(None, None) if c is None else next(told) for c in held]
            columns = [*b.columns[:-1], pa.array([t for t, _ in both], pa.string()), pa.array([e for _, e in both], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*key, "text", "error"])

    return df.select(*key, F.col(content).alias("__content")).mapInArrow(run, schema)
