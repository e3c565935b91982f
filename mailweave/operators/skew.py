"""Joins and rankings that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
HOT_ROWS = 1_000_000


def hot_keys(facts: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys of ``facts`` with more than ``hot_rows`` rows: at most one in ``hot_rows`` rows can be such a key.

    Counting combines map-side, so a hot key moves one partial count per input partition.
    """
    return facts.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") > hot_rows).select(key)


def lookup_join(
    facts: DataFrame, dimension: DataFrame, key: str, salt_by: str,
    how: str = "left", hot_rows: int = HOT_ROWS, salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to a ``dimension`` that is unique on ``key``.

    Rows of hot keys are spread over ``salts`` reducers by a hash of ``salt_by``; the matching dimension
    rows are repeated as often.  All other keys take the plain shuffle join.  Rows without a key meet nothing, so they are never
    shuffled: a left join gets them back at the end.
    """
    hot = hot_keys(facts, key, hot_rows).withColumn("_hot", F.lit(True))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    left = facts.filter(F.col(key).isNotNull()).join(hot, key, "left").withColumn("_salt", spread).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dimension.filter(F.col(key).isNotNull()).join(hot, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    joined = left.join(right, [key, "_salt"], how).drop("_salt")
    if how == "left":
        joined = joined.unionByName(facts.filter(F.col(key).isNull()), allowMissingColumns=True)
    return joined


def spread_nulls(key: str, salt_by: str) -> Column:
    """A join key that is ``key`` where there is one and otherwise meets nothing: rows without a key go to many reducers."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(salt_by).cast("string")))


def first_n_per_key(
    rows: DataFrame, keys: list[str], order: list[Column], n: int, salt_by: str,
    rank: str = "rank", salts: int = SALTS,
) -> DataFrame:
    """The first ``n`` rows of each key.

    Ranks within salted slices before ranking within the key, so the last step sees no more than
    ``n * salts`` rows of any key.
    """
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    kept = sliced.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= n).drop("_r", "_slice")
    outer = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= n)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` as they lie, unless they lie in fewer partitions than there are cores.

    For stages whose work is in the rows, such as cutting texts into words.  Tables of any size have partitions enough and are not
    moved; only a small input, say one file, is dealt out by its unique ``key``.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if planned_partitions(rows) >= cores else rows.repartition(cores, key)


def planned_partitions(rows: DataFrame) -> int:
    """In how many partitions ``rows`` are planned to lie.

    An adaptive plan runs all its exchanges before it can tell, and what it has run is not used again.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.adaptive.enabled"
    adaptive = conf.get(name)
    conf.set(name, "false")
    try:
        return rows.select("*").rdd.getNumPartitions()
    finally:
        conf.set(name, adaptive)
