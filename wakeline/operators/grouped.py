"""Keyed, ordered streaming of rows into numpy.

``grouped_blocks`` is the bridge used by the operators that are sequential
inside a key: the JVM shuffles and sorts (spilling when it has to), Python sees
blocks of *whole* groups as numpy arrays and works on all groups of a block at
once, so that many small groups cost no more than one large one.  Keys must be
bounded by construction (vessel-day, space-time cell, hash shard ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_ROWS = 50_000


def as_numpy(col: pa.ChunkedArray) -> np.ndarray:
    """Column as numpy; nulls of floating columns become NaN."""
    return col.to_numpy()


def key_change(arrays: Sequence[np.ndarray]) -> np.ndarray:
    """True where a row starts a new key; the first row always does."""
    n = len(arrays[0])
    out = np.zeros(n, dtype=bool)
    if n:
        out[0] = True
        for a in arrays:
            out[1:] |= a[1:] != a[:-1]
    return out


def blocks_of_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int) -> Iterator[pa.Table]:
    """Re-cut a key-sorted stream into tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(key_change([as_numpy(table[k]) for k in keys]))
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def grouped_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pa.Table], pa.Table | None],
    schema: str,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``fn`` to key-complete, sorted blocks of ``df``.

    One hash exchange on ``keys``; AQE may merge its small partitions.  ``fn``
    gets a table with the columns of ``df`` and returns one with ``schema``.
    An empty input gives an empty result.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks_of_groups(batches, keys, rows):
            out = fn(table)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
