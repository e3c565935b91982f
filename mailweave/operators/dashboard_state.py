"""What the dashboard and the thread list show, kept as rows that add up.

A batch of mails leaves one row for each thing it mentions: all mails, a sender, a receiver, a day, a subject, a thread, an archive, and
each address in each thread.  A row counts mails, those with a summary, and holds their first and last date.  Rows of several batches
are added, so figures over everything are read from the state and no mail is read again.  Mails that are taken away leave rows
with a minus sign; dates of what is left are then bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.operators.analytics import DAYS, OVERVIEW, TOP, assembled, thread_size_distribution

KEYS = ("kind", "key", "who")


def state_of(emails: DataFrame) -> DataFrame:
    """``(kind, key, who, n, summaries, first, last)`` of mails with thread, from one pass over them; texts are not read."""
    def thing(kind: str, key, who=None):
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), (F.lit("") if who is None else who).alias("who"))

    def things(kind: str, values):
        return F.transform(F.array_distinct(values), lambda v: thing(kind, v))

    receivers, cc = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("receivers", "cc"))
    people = F.array_union(F.array_union(F.array("sender"), receivers), cc)
    told = F.concat(
        F.array(thing("mail", F.lit("")), thing("sender", F.col("sender")), thing("day", F.to_date("sent_at")),
                thing("subject", F.when(F.col("subject") != "", F.col("subject"))), thing("thread", F.col("thread_id")), thing("archive", F.col("archive_id"))),
        things("receiver", receivers), F.transform(people, lambda p: thing("member", F.col("thread_id"), p)))
    rows = emails.select((F.coalesce("summary", F.lit("")) != "").alias("summed"), "sent_at", F.inline(told)).filter("key is not null and who is not null")
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if("summed").alias("summaries"), F.min("sent_at").alias("first"), F.max("sent_at").alias("last"))


def merged(*states: DataFrame) -> DataFrame:
    """States of several batches as one."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("summaries").alias("summaries"), F.min("first").alias("first"), F.max("last").alias("last"))


def added(*states: DataFrame) -> DataFrame:
    """The state of everything: things that no mail mentions any more are gone."""
    return merged(*states).filter("n > 0")


def taken_away(state: DataFrame) -> DataFrame:
    """The state of mails that are deleted, to be added."""
    nothing = F.lit(None).cast(state.schema["first"].dataType)
    return state.select(*KEYS, (-F.col("n")).alias("n"), (-F.col("summaries")).alias("summaries"), nothing.alias("first"), nothing.alias("last"))


def overview(state: DataFrame) -> DataFrame:
    """The eight figures, from one pass over an ``added`` state."""
    of = lambda kind: F.col("kind") == kind
    return state.agg(
        F.coalesce(F.max(F.when(of("mail"), F.col("n"))), F.lit(0)).alias("total_emails"), F.count_if(of("thread")).alias("total_threads"),
        F.count_if(of("archive")).alias("total_archives"), F.count_if(of("sender")).alias("unique_senders"),
        F.count_if(of("receiver")).alias("unique_receivers"), F.coalesce(F.max(F.when(of("mail"), F.col("summaries"))), F.lit(0)).alias("emails_with_summary"),
        F.min(F.when(of("mail"), F.col("first"))).alias("date_range_start"), F.max(F.when(of("mail"), F.col("last"))).alias("date_range_end"),
    ).select(*OVERVIEW)


def ranking(state: DataFrame, kind: str, name: str, limit: int = TOP) -> DataFrame:
    """The most frequent senders or subjects: ``(name, count)``."""
    rows = state.filter(F.col("kind") == kind).select(F.col("key").alias(name), F.col("n").alias("count"))
    return rows.orderBy(F.desc("count"), name).limit(limit)


def daily_volume(state: DataFrame, days: int = DAYS) -> DataFrame:
    rows = state.filter(F.col("kind") == "day").select(F.to_date("key").alias("day"), F.col("n").alias("count"))
    return rows.orderBy(F.desc("day")).limit(days).orderBy("day")


def thread_sizes(state: DataFrame) -> DataFrame:
    return thread_size_distribution(state.filter(F.col("kind") == "thread").select(F.col("n").alias("email_count")))


def thread_figures(state: DataFrame) -> DataFrame:
    """``(thread_id, email_count, participant_count, first_email_at, last_email_at)``; a busy thread is one partial sum a task."""
    rows = state.filter(F.col("kind").isin("thread", "member"))
    own = F.col("kind") == "thread"
    return rows.groupBy(F.col("key").alias("thread_id")).agg(
        F.sum(F.when(own, F.col("n"))).alias("email_count"), F.count_if(~own).alias("participant_count"),
        F.min(F.when(own, F.col("first"))).alias("first_email_at"), F.max(F.when(own, F.col("last"))).alias("last_email_at"))


def dashboard(state: DataFrame) -> DataFrame:
    """One row: the overview and the four panels as nested values."""
    return assembled(overview(state), ranking(state, "sender", "sender"), daily_volume(state), ranking(state, "subject", "subject"), thread_sizes(state))
