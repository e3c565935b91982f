"""Fact-table sinks: appended by archive, or clustered for look-ups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailweave.functions.text import let


def append_emails(emails: DataFrame, path: str) -> None:
    """Append mails, one folder per archive.

    The rebalance hint gathers an archive's rows into few files, and splits a very large archive over several tasks.
    """
    emails.hint("rebalance", "archive_id").write.mode("append").partitionBy("archive_id").parquet(path)


def read_emails(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    reader = spark.read
    if like is not None:
        reader = reader.schema(like.schema)
    return reader.parquet(path)


ROW_GROUP_BYTES = 32 * 1024 * 1024
FILE_ROWS, MAX_FILES = 8192, 4096
KEYS_A_FILE = 100  # keys that a range's limits are chosen from
LOOKED_UP = ("id", "message_id")


def in_ranges(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``rows`` in one partition a range of ``order``, by limits that are chosen from these columns alone.

    Ranging by Spark works out whole rows twice, once for a sample: texts and all are read from their join again.  Limits are a
    sample of ``KEYS_A_FILE`` keys a file; every row is placed by them.
    """
    keys = rows.select(*order)
    count = keys.count()
    files = min(MAX_FILES, max(1, -(-count // FILE_ROWS)))
    # A hash of the key chooses, so that a repeated run places rows alike.
    chosen = keys.filter(F.pmod(F.xxhash64(*order), F.lit(max(1, count // (files * KEYS_A_FILE)))) == 0)
    every = F.row_number().over(Window.orderBy(*order))
    limits = chosen.select(F.struct(*order).alias("limit"), every.alias("n")).filter(F.col("n") % KEYS_A_FILE == 0).agg(
        F.sort_array(F.collect_list("limit")).alias("_limits"))
    # Two short searches in place of one along all limits.
    step, key, found = math.isqrt(files) + 1, F.struct(*order), F.col("_limits")
    below = lambda listed: F.size(F.filter(listed, lambda limit: limit <= key))
    blocks = below(F.filter(found, lambda _, i: i % step == 0))
    part = let(blocks, lambda n: F.when(n > 0, (n - 1) * step + below(F.slice(found, F.greatest(n - 1, F.lit(0)) * step + 1, step))).otherwise(0))
    placed = rows.crossJoin(F.broadcast(limits)).withColumn("_part", F.least(part, F.lit(files - 1))).drop("_limits")
    return placed.repartitionById(files, F.col("_part").cast("int")).drop("_part")


def write_clustered(rows: DataFrame, path: str, order: tuple[str, ...] = ("sent_at", "id"), looked_up: tuple[str, ...] = LOOKED_UP,
                    row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write a table so that look-ups read the row groups that match and no others.

    Rows lie in ranges of ``order``, so a date range meets neighbouring row groups by their least and largest values.  Ids and message ids
    are spread over the whole table by that; each row group has a Bloom filter for them, which an equality test asks before any page is read.
    Times with a zone have least and largest values only if the session writes them as such (``session.DEFAULTS`` does).
    """
    ranged = in_ranges(rows, order).sortWithinPartitions(*order)
    writer = ranged.write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("compression", "zstd")
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
