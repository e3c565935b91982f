"""Mail tables derived from the shared test tables (see FIXTURES.md for the view's definition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.text import extractive_summary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _address(number) -> F.Column:
    return F.concat(F.lit("user"), number.cast("string"), F.lit("@example.com"))


def mail_from(documents: DataFrame, events: DataFrame) -> DataFrame:
    """The adapter view over given ``documents`` and ``events`` frames."""
    n = F.col("doc_id")

    def message(number):
        return F.concat(F.lit("m"), number.cast("bigint").cast("string"), F.lit("@example.org"))

    topic = F.when(n % 29 == 0, F.lit("")).otherwise(F.concat(F.lit("Topic "), (n % 40).cast("string")))
    prefix = F.when(n % 4 == 0, "").when(n % 4 == 1, "Re: ").when(n % 4 == 2, "FWD: re:  ").otherwise("fw:")
    # Other events meet no document; they need not be moved.
    met = events.filter(F.col("event_id") % 5 == 0).select("event_id", "ts", "user_id")
    joined = documents.withColumn("event_id", n * 5).join(met, "event_id")
    return joined.select(
        n.alias("email_id"),
        F.col("source").alias("archive_id"),
        F.when(n % 17 != 0, message(n)).alias("message_id"),
        F.when(n % 3 != 0, message((n - n % 3) / 3)).alias("in_reply_to"),
        F.when(n % 5 == 1, F.concat(F.lit("<"), message((n - n % 9) / 9), F.lit("> <"),
                                    message((n - n % 3) / 3), F.lit(">"))).alias("references_header"),
        _address(F.col("user_id")).alias("sender"),
        F.when(n % 11 == 0, "").when(n % 2 == 0, _address(n % 7))
         .otherwise(F.concat(_address(n % 7), F.lit(","), _address(7 + n % 5))).alias("receivers_csv"),
        F.when(n % 13 == 0, _address(n % 19)).otherwise("").alias("cc_csv"),
        F.concat(prefix, topic).alias("subject"),
        F.col("text").alias("body_text"),
        F.when(n % 23 != 0, F.col("ts")).alias("sent_at"),
    )


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "events"))


def _csv(name: str) -> F.Column:
    return F.filter(F.split(F.col(name), ","), lambda a: a != "")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table: adapter rows with address arrays, a creation time, a summary and a source name."""
    base = mail(spark, sf_dir)
    created = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, email_id)")
    return base.select(
        F.col("email_id").alias("id"), "archive_id", "message_id", "in_reply_to", "references_header", "sender",
        _csv("receivers_csv").alias("receivers"), _csv("cc_csv").alias("cc"), "subject", "body_text", "sent_at",
        extractive_summary(F.col("subject"), F.col("body_text")).alias("summary"),
        F.concat(F.lit("mail-"), F.col("email_id").cast("string"), F.lit(".eml")).alias("source_file"),
        created.alias("created_at"),
    )


def threaded_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table with its archive-mode thread id, which is a function of the row alone."""
    from mailweave.operators.threads import with_subject_thread

    return with_subject_thread(emails(spark, sf_dir))


__all__ = ["emails", "mail", "mail_from", "table", "threaded_emails"]
