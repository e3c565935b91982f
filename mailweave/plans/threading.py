"""Thread queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweave.operators import threads as T
from mailweave.operators.growing_threads import GrowingThreads
from mailweave.plans import tables
from mailweave.plans.registry import query
from mailweave.session import materialise, scratch_path
from mailweave.sources.testmail import emails, threaded_emails


@query
def threads_by_subject(spark, sf):
    return T.threads_by_subject(emails(spark, sf))


@query
def threads_by_header(spark, sf):
    return T.threads_by_header(emails(spark, sf))


@query
def threads_global(spark, sf):
    return T.threads_global(emails(spark, sf))


@query
def threads_grown(spark, sf):
    """The same threads after the mails have come in three batches, the latest first."""
    rows, grown = emails(spark, sf), GrowingThreads(spark, scratch_path(spark, "threads"), buckets=4)
    for batch in range(3):
        grown.add(batch, rows.filter(F.col("id") % 3 == 2 - batch))
    return grown.threads()


@query
def thread_root(spark, sf):
    return T.thread_roots(threaded_emails(spark, sf), ("archive_id", "thread_key"))


@query
def thread_stats(spark, sf):
    return tables.threads(spark, sf).drop("summary")


@query
def thread_summary(spark, sf):
    return T.thread_summaries(threaded_emails(spark, sf), ("archive_id", "thread_key"))


@query
def reply_parent_join(spark, sf):
    return T.reply_parents(emails(spark, sf))


@query
def reference_root(spark, sf):
    return T.reference_roots(emails(spark, sf))


@query
def latest_per_message_id(spark, sf):
    """Mails and their forwarded copies (a second row per mail that has references, dated as its parent)."""
    rows = emails(spark, sf).select("id", "message_id", "in_reply_to", "references_header", "sent_at", "created_at")
    copies = rows.filter(F.col("references_header").isNotNull()).withColumn("message_id", F.col("in_reply_to")).withColumn(
        "id", -F.col("id"))
    return T.latest_per_message_id(rows.unionByName(copies))


@query
def participant_union(spark, sf):
    who = T.participants(F.col("sender"), F.col("receivers"), F.col("cc"))
    return emails(spark, sf).select("id", F.array_join(F.array_sort(who), ",").alias("participants"))


def _matched(spark, sf):
    """Threads of archives with short names are stored already; the others are matched against them."""
    rows = threaded_emails(spark, sf).select(*tables.NEEDED_FOR_THREADS)
    stats = materialise(T.thread_stats(rows, ("archive_id", "thread_id")), "thread-stats")
    old = F.length("archive_id") <= 4
    existing = stats.filter(old).select(F.col("thread_id").alias("id"), "subject_normalized", "root_message_id")
    groups = stats.filter(~old).select(
        F.col("thread_id").alias("group_id"), "archive_id", "subject_normalized", "root_message_id", "email_count")
    return T.match_or_create(groups, existing)


@query
def thread_match_or_create(spark, sf):
    return _matched(spark, sf).drop("group_id")


@query
def thread_refresh(spark, sf):
    """New statistics and summaries of the threads that new mails were matched to, from old and new mails."""
    matched = materialise(_matched(spark, sf).select("group_id", F.col("thread_id").alias("_matched")), "thread-matches")
    rows = threaded_emails(spark, sf)
    members = rows.join(matched, rows["thread_id"] == matched["group_id"], "left").withColumn(
        "thread_id", F.coalesce("_matched", "thread_id"))
    return T.refreshed(members, matched.select(F.col("_matched").alias("thread_id")))
