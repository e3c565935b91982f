"""Threads and archives derived from the test mails, shared by the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.operators.threads import thread_stats
from mailweave.session import files_stamp, scratch_path
from mailweave.sources.tables import write_clustered
from mailweave.sources.testmail import emails, threaded_emails

NEEDED_FOR_THREADS = (
    "id", "archive_id", "thread_id", "thread_key", "message_id", "in_reply_to", "sender", "receivers", "cc", "subject",
    "sent_at", "created_at",
)


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threaded_emails(spark, sf_dir).select(*NEEDED_FOR_THREADS)
    return thread_stats(rows).withColumnRenamed("thread_id", "id").withColumn("summary", F.lit(None).cast("string"))


_stored: dict[tuple, DataFrame] = {}


def stored_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mails as a clustered table, written on first use in this application and again when their files have changed."""
    key = (spark.sparkContext.applicationId, sf_dir, files_stamp(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/events.parquet"))
    if key not in _stored:
        path = scratch_path(spark, "mails")
        write_clustered(emails(spark, sf_dir), path)
        _stored[key] = spark.read.parquet(path)
    return _stored[key]


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per archive; mails without a message id stand for those not processed yet."""
    rows = emails(spark, sf_dir).groupBy("archive_id").agg(
        F.count("*").alias("total_emails"), F.count("message_id").alias("processed_emails"),
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return rows.select(
        F.col("archive_id").alias("id"), F.concat("archive_id", F.lit(".zip")).alias("filename"),
        F.when(F.col("total_emails") == F.col("processed_emails"), "completed").otherwise("processing").alias("status"),
        "total_emails", "processed_emails", F.lit(None).cast("string").alias("error_message"),
        "created_at", "updated_at")
