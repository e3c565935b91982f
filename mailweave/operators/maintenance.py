"""Table upkeep: upserts, deletes, audits and rebuild counts.  Tables are replaced by new snapshots."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.operators import keyword as K
from mailweave.operators.vectors import vector_index

AUDIT_BUCKETS = 4096


def latest_by_id(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per id, that of the highest version, as a partial aggregate.

    A row without a version counts as the oldest; between equal versions a hash of the row decides, whatever the partitioning.
    """
    others = [c for c in rows.columns if c != key]
    order = F.struct(F.col(version).isNotNull(), F.col(version), F.xxhash64(*others))
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row")).select(key, "_row.*")


def upsert(base: DataFrame, delta: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """``base`` with the rows of ``delta`` written over it; of several rows of an id in ``delta`` the last wins."""
    fresh = latest_by_id(delta, key, version)
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` with the rows of ``new`` whose id it lacks; of several new rows of an id one, chosen by a hash of the row."""
    others = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_row")).select(key, "_row.*")
    return existing.unionByName(one.join(existing.select(key), key, "left_anti"))


def delete_rows(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose key is in ``deleted``; serves mails, postings and vectors alike."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def clear_thread(emails: DataFrame, deleted_threads: DataFrame) -> DataFrame:
    """Mails of deleted threads stay but lose their thread."""
    gone = deleted_threads.select("thread_id").distinct().withColumn("_gone", F.lit(True))
    return (
        emails.join(gone, "thread_id", "left")
        .withColumn("thread_id", F.when(F.col("_gone").isNull(), F.col("thread_id"))).drop("_gone")
    )


def fingerprints(ids: DataFrame, key: str = "id", buckets: int = AUDIT_BUCKETS) -> DataFrame:
    """``(bucket, n, mark)``: how many ids a bucket holds, and a sum of their hashes that does not depend on order."""
    h = F.xxhash64(F.lit(1), key)
    return ids.groupBy(audit_bucket(key, buckets).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("mark"))


def audit_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def unequal_buckets(emails: DataFrame, index_ids: DataFrame, key: str = "id", buckets: int = AUDIT_BUCKETS) -> tuple[list[int], int]:
    """The buckets whose ids differ, and how many ids are in the others.  Moves a row a bucket and task, and no id."""
    left, right = fingerprints(emails, key, buckets), fingerprints(index_ids, key, buckets)
    both = left.join(right.select("bucket", F.col("n").alias("m"), F.col("mark").alias("other")), "bucket", "full_outer")
    rows = both.select("bucket", "n", ((F.col("n") == F.col("m")) & (F.col("mark") == F.col("other"))).alias("same")).collect()
    return sorted(r.bucket for r in rows if not r.same), sum(r.n for r in rows if r.same)


def index_audit(emails: DataFrame, index_ids: DataFrame, key: str = "id", buckets: int = AUDIT_BUCKETS) -> DataFrame:
    """Counts of mails found in both places, missing in the index, or left over in it; ``emails`` has an id once.

    Buckets of ids with equal fingerprints are in both places; only the ids of the others are compared one by one.
    """
    spark = emails.sparkSession
    unequal, agreed = unequal_buckets(emails, index_ids, key, buckets)
    here = audit_bucket(key, buckets).isin(unequal)
    # Stack and fold instead of a full outer join: one shuffle of bare ids.
    marks = emails.filter(here).select(key, F.lit(1).alias("table"), F.lit(0).alias("index")).unionByName(
        index_ids.filter(here).select(key, F.lit(0).alias("table"), F.lit(1).alias("index")))
    seen = marks.groupBy(key).agg(F.max("table").alias("table"), F.max("index").alias("index"))
    state = (
        F.when((F.col("table") == 1) & (F.col("index") == 1), "in_both")
        .when(F.col("table") == 1, "missing_in_index").otherwise("orphan")
    )
    counted = seen.groupBy(state.alias("state")).agg(F.count("*").alias("count"))
    rest = spark.range(1).select(F.lit("in_both").alias("state"), F.lit(agreed).cast("bigint").alias("count"))
    return counted.unionByName(rest).groupBy("state").agg(F.sum("count").alias("count")).filter("count > 0")


# ---- Stored indexes ----------------------------------------------------------------------------------------

def rebuild(emails: DataFrame, folder: str) -> None:
    """Write the keyword index and the vectors of all mails anew below ``folder``."""
    K.write_index(emails, os.path.join(folder, "keyword"))
    vector_index(emails).write.mode("overwrite").parquet(os.path.join(folder, "vectors"))


def delete_stored(spark: SparkSession, folder: str, new_folder: str, deleted: DataFrame) -> None:
    """A new snapshot of the stored indexes without some mails (``id``); vocabulary and lengths are counted again."""
    source, target = os.path.join(folder, "keyword"), os.path.join(new_folder, "keyword")
    kept = delete_rows(spark.read.parquet(os.path.join(source, "postings")), deleted, "id")
    (kept.repartitionByRange("term_bucket", "field", "term", "id").sortWithinPartitions("term_bucket", "field", "term", "id")
     .write.mode("overwrite").partitionBy("term_bucket").parquet(os.path.join(target, "postings")))
    left = spark.read.parquet(os.path.join(target, "postings"))
    K.store_vocabulary(left, target)
    K.store_stats(K.stats_without(left), target)
    delete_rows(spark.read.parquet(os.path.join(folder, "vectors")), deleted, "id").write.mode("overwrite").parquet(
        os.path.join(new_folder, "vectors"))
