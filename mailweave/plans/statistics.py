"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweave.operators import analytics as A
from mailweave.operators import dashboard_state as S
from mailweave.plans import tables
from mailweave.plans.registry import query
from mailweave.session import scratch_path
from mailweave.sources.testmail import emails, threaded_emails
from mailweave.streaming.parts import Parts


def thread_sizes(spark, sf):
    return A.thread_sizes(threaded_emails(spark, sf))


@query
def counts(spark, sf):
    return A.one_row(
        A.row_count(emails(spark, sf), "emails"),
        A.row_count(thread_sizes(spark, sf), "threads"),
        A.row_count(tables.archives(spark, sf), "archives"),
    )


@query
def unique_senders(spark, sf):
    return A.unique_senders(emails(spark, sf))


@query
def unique_receivers(spark, sf):
    return A.unique_receivers(emails(spark, sf))


@query
def with_summary(spark, sf):
    return A.with_summary(emails(spark, sf))


@query
def date_range(spark, sf):
    return A.date_range(emails(spark, sf))


@query
def top_senders(spark, sf):
    return A.top_senders(emails(spark, sf))


@query
def daily_volume(spark, sf):
    return A.daily_volume(emails(spark, sf))


@query
def top_subjects(spark, sf):
    return A.top_subjects(emails(spark, sf))


@query
def thread_size_dist(spark, sf):
    return A.thread_size_distribution(thread_sizes(spark, sf))


@query
def overview(spark, sf):
    return A.overview(emails(spark, sf), thread_sizes(spark, sf), tables.archives(spark, sf))


@query
def dashboard(spark, sf):
    return A.dashboard_rows(A.dashboard(emails(spark, sf), thread_sizes(spark, sf), tables.archives(spark, sf)))


def grown_state(spark, sf):
    """The dashboard's state after the mails have come in three batches."""
    rows, parts = threaded_emails(spark, sf), Parts(spark, scratch_path(spark, "state"))
    for batch in range(3):
        parts.add(batch, {"dashboard": S.state_of(rows.filter(F.col("id") % 3 == batch))})
    parts.merge(fan=2)
    return parts.dashboard()


@query
def overview_state(spark, sf):
    """The overview read from the state of all batches."""
    return S.overview(grown_state(spark, sf))


@query
def dashboard_state(spark, sf):
    """The whole dashboard read from the state of all batches."""
    return A.dashboard_rows(S.dashboard(grown_state(spark, sf)))


@query
def thread_figures_state(spark, sf):
    """Sizes, participants and dates of all threads, read from the state of all batches."""
    return S.thread_figures(grown_state(spark, sf))


@query
def archive_progress(spark, sf):
    return A.archive_progress(tables.archives(spark, sf)).select(
        "id", "status", "total_emails", "processed_emails", F.col("progress"))
