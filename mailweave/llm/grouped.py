"""Groups of consecutive rows in a stream of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together and in a row, so that ``groups`` can follow; a task streams over many small groups."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        cuts = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != at:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(a, b - a))
    if held:
        yield at, pa.Table.from_batches(held)
