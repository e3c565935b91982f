"""What the vector operators share: which vectors take part, classes of equal vectors, matrices from binary columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows that take part: an id, no null or non-finite component, not zero, not empty."""
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return typed.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """A list column whose rows are equally long, as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)
