"""What the operators share: folds, scratch tables in the shared folder, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.session import scratch_path

# Rows of one Arrow batch: whole documents are long, so few of them keep a Python worker's memory bounded.
BATCH_ROWS = 256
BATCH_BYTES = "2m"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write once below ``spark.checkpoint.dir`` and read back: lineage is cut and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch = path
    return back


def discard(df: DataFrame) -> None:
    """Delete a table of ``write_scratch`` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session set to Arrow batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, next to those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def thrifty(function: Callable) -> Callable:
    """A map over Arrow batches that gives its memory back when a task is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def map_batches(df: DataFrame, schema: str, function: Callable[[pa.RecordBatch], dict], finish: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``function`` (record batch -> columns) to every Arrow batch of ``df``, in place: no shuffle.

    ``finish`` is called when a task is done: workers serve many tasks, so what one has remembered is given up there.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch), schema=arrow)
        if finish:
            finish()

    return small_batches(df).mapInArrow(thrifty(run), schema)


def sample_by_hash(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows whose seeded hash of ``key`` lies below ``fraction``: the same rows for any partitioning."""
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(fraction * (1 << 30)))


ID_BITS = 23  # bits of a set of ids: 1 MB, whatever the input


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit for the hash of every ``doc_id``; collected in parts of 4 kB, 1 MB in all."""
    # Positions count from 1.
    rows = ids.select((id_spot() + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    bits = np.zeros((1 << ID_BITS) // 8, dtype=np.uint8)
    for r in rows:
        bits[(r.part - 1) * 4096:r.part * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return bits


def id_spot() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << ID_BITS))


def has_bit(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (bits[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1 == 1


def split_by_id(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``doc_id`` is surely not in ``ids``, and the others, which may be and are few where ``ids`` are few.

    Only the second part needs an exact join, so most rows are never moved.
    """
    sent = rows.sparkSession.sparkContext.broadcast(id_bits(ids))

    @F.pandas_udf("boolean")
    def may_be_in(h: pd.Series) -> pd.Series:
        return pd.Series(has_bit(sent.value, h.to_numpy()))

    flagged = F.coalesce(may_be_in(id_spot()) & F.col("doc_id").isNotNull(), F.lit(False))
    return rows.filter(~flagged), rows.filter(flagged)
