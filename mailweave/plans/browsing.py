"""Lookup, filter, projection, paging and enrichment queries."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from mailweave.operators import browse as B
from mailweave.plans import tables
from mailweave.plans.registry import query
from mailweave.sources.testmail import emails, threaded_emails

# Request values of the sample queries.
EMAIL_ID = 42
EMAIL_IDS = [77, 3, 10**12, 150, 8, 3]
MESSAGE_ID = "m31@example.org"
SENDER = "USER1"
THREAD = ("src5", "Topic 5")
DATE_FROM, DATE_TO = datetime(2024, 1, 10), datetime(2024, 1, 20, 12)
PAGE, PAGE_SIZE = 2, 20


def thread_id_of(archive: str, key: str):
    """The thread id expression of an archive and group key."""
    return F.sha2(F.concat_ws("\u001f", F.lit(archive), F.lit(key)), 256)


@query
def lookup_by_id(spark, sf):
    return B.by_id(tables.stored_mails(spark, sf), EMAIL_ID).select("id", "sender", "subject", "sent_at", "summary")


@query
def lookup_by_ids(spark, sf):
    return B.by_ids_in_order(emails(spark, sf), EMAIL_IDS).select("pos", "id", "sender", "subject")


@query
def lookup_by_message_id(spark, sf):
    return B.first_by_value(tables.stored_mails(spark, sf), "message_id", MESSAGE_ID).select("id", "message_id", "subject")


@query
def filter_sender(spark, sf):
    return B.filtered(emails(spark, sf), sender=SENDER).select("id", "sender", "subject", "sent_at")


@query
def filter_sender_wildcard(spark, sf):
    """Pattern form: the request's ``_`` stands for any letter."""
    return B.filtered(emails(spark, sf), sender="r_5@ex%com", escape=False).select("id", "sender", "subject", "sent_at")


@query
def filter_sender_thread(spark, sf):
    rows = threaded_emails(spark, sf)
    return B.filtered(rows, sender="user").filter(F.col("thread_id") == thread_id_of(*THREAD)).select(
        "id", "sender", "subject", "thread_id")


@query
def project_list_item(spark, sf):
    return B.list_items(threaded_emails(spark, sf))


@query
def project_detail(spark, sf):
    rows = B.details(threaded_emails(spark, sf))
    return rows.withColumn("receivers", F.array_join("receivers", ",")).withColumn("cc", F.array_join("cc", ","))


@query
def index_document(spark, sf):
    rows = B.index_documents(threaded_emails(spark, sf))
    return rows.withColumn("receivers", F.array_join("receivers", ",")).withColumn("cc", F.array_join("cc", ","))


@query
def vector_metadata(spark, sf):
    return B.vector_metadata(threaded_emails(spark, sf))


@query
def kw_date_range(spark, sf):
    rows = tables.stored_mails(spark, sf)
    return rows.filter(B.in_date_range(*map(_ntz, (DATE_FROM, DATE_TO)))).select("id", "sent_at")


def _ntz(moment: datetime):
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


@query
def email_with_thread(spark, sf):
    return B.with_thread(threaded_emails(spark, sf).select("id", "sender", "subject", "thread_id"), tables.threads(spark, sf))


@query
def thread_with_emails(spark, sf):
    return B.threads_with_emails(tables.threads(spark, sf), threaded_emails(spark, sf))


@query
def thread_detail(spark, sf):
    wanted = hashlib.sha256("\u001f".join(THREAD).encode()).hexdigest()
    return B.thread_detail(tables.threads(spark, sf), threaded_emails(spark, sf), wanted)


@query
def hydrate_hits(spark, sf):
    """Every mail as a hit: those without message id point to a mail that is gone, some have their own summary."""
    rows = emails(spark, sf)
    hits = rows.select(
        F.when(F.col("message_id").isNull(), -F.col("id")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("in_reply_to").isNotNull(), F.col("subject")).alias("summary"),
        F.when(F.col("references_header").isNotNull(), "excerpt").otherwise("").alias("snippet"))
    return B.hydrate(hits, rows)


@query
def page_emails(spark, sf):
    return B.email_page(emails(spark, sf), PAGE, PAGE_SIZE).select("id", "sender", "subject", "sent_at")


@query
def page_threads(spark, sf):
    return B.thread_page(tables.threads(spark, sf), PAGE, PAGE_SIZE).select("id", "subject_normalized", "last_email_at")


@query
def page_archives(spark, sf):
    return B.archive_page(tables.archives(spark, sf), 1, 7).select("id", "filename", "status", "created_at")


@query
def page_totals(spark, sf):
    return B.page_totals(emails(spark, sf), PAGE_SIZE)
