"""Rows of an Arrow stream, block by block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, for Python: the session's Arrow batches are brought down to BATCH_BYTES, as both the JVM and Python hold whole
    ones. A session that has smaller ones keeps them."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name, None)
    digits = "".join(c for c in held or "" if c.isdigit())
    if digits and (not held.strip().lower().rstrip("b").isdigit() or int(digits) > BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df


def pieces(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of rows with equal values, none of them null, in the first `keys` columns of a batch. A run
    that goes on in the next batch comes in several pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changed = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            yield tuple(c[first] for c in columns), batch.slice(first, last - first)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each run of rows, whole: for runs of a bounded size."""
    now, held = None, []
    for key, rows in pieces(batches, keys):
        if key != now and held:
            yield now, pa.Table.from_batches(held).combine_chunks()
            held = []
        now = key
        held.append(rows)
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def matrix(column, kind=np.float64) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)
