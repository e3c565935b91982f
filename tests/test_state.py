"""Figures from states that add up, audits by fingerprints, exact fields."""

import pytest
from pyspark.sql import functions as F

from mailweave.operators import analytics as A
from mailweave.operators import dashboard_state as S
from mailweave.operators import keyword as K
from mailweave.operators import maintenance as M
from mailweave.sources.testmail import threaded_emails
from mailweave.streaming.parts import Parts


def rows_of(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


@pytest.fixture(scope="module")
def mails(spark, sf):
    return threaded_emails(spark, sf)


def whole(mails):
    threads = mails.select(F.col("thread_id").alias("id")).distinct()
    return A.overview(mails, threads, mails.select("archive_id").distinct())


def test_state_of_batches_equals_one_from_scratch(spark, mails, tmp_path):
    parts = Parts(spark, str(tmp_path / "s"))
    for b in range(4):
        parts.add(b, {"dashboard": S.state_of(mails.filter(F.col("id") % 4 == b))})
        parts.merge(fan=2)
        some = mails.filter(F.col("id") % 4 <= b)
        assert rows_of(S.overview(parts.dashboard())) == rows_of(whole(some))
    state = parts.dashboard()
    assert rows_of(S.ranking(state, "sender", "sender")) == rows_of(A.top_senders(mails))
    assert rows_of(S.daily_volume(state)) == rows_of(A.daily_volume(mails))
    assert rows_of(S.ranking(state, "subject", "subject")) == rows_of(A.top_subjects(mails))
    assert rows_of(S.thread_sizes(state)) == rows_of(A.thread_size_distribution(A.thread_sizes(mails)))
    plan = S.overview(state)._jdf.queryExecution().executedPlan().toString()
    assert "body_text" not in plan and "documents" not in plan and "events" not in plan


def test_states_of_deleted_mails(spark, mails):
    gone = mails.filter("id % 5 = 0")
    left = mails.filter("id % 5 <> 0")
    state = S.added(S.state_of(mails), S.taken_away(S.state_of(gone)))
    dates = ["date_range_start", "date_range_end"]
    assert rows_of(S.overview(state).drop(*dates)) == rows_of(whole(left).drop(*dates))
    assert rows_of(S.thread_figures(state).select("thread_id", "email_count", "participant_count")) == rows_of(
        S.thread_figures(S.added(S.state_of(left))).select("thread_id", "email_count", "participant_count"))


def test_state_of_odd_mails(spark):
    schema = "id long, archive_id string, thread_id string, sender string, receivers array<string>, cc array<string>, subject string, summary string, sent_at timestamp"
    rows = [(1, None, None, None, None, None, None, None, None), (2, "a", "t", "x", ["x", "y", "y"], ["z", None], "", "", None)]
    got = S.overview(S.added(S.state_of(spark.createDataFrame(rows, schema)))).first()
    assert (got.total_emails, got.total_threads, got.total_archives, got.unique_senders, got.unique_receivers, got.emails_with_summary) == (2, 1, 1, 1, 2, 0)
    empty = S.overview(S.added(S.state_of(spark.createDataFrame([], schema)))).first()
    assert empty.total_emails == 0 and empty.date_range_start is None
    one = S.thread_figures(S.added(S.state_of(spark.createDataFrame(rows, schema)))).first()
    assert (one.email_count, one.participant_count) == (1, 3)


def test_audit_compares_ids_of_unequal_buckets_only(spark):
    mails, index = spark.range(20_000), spark.range(20_000).filter("id not in (17, 4000)").unionByName(spark.range(50_000, 50_001))
    unequal, agreed = M.unequal_buckets(mails, index)
    assert len(unequal) <= 3 and 19_900 < agreed < 20_000
    audit = M.index_audit(mails, index)
    assert {r.state: r["count"] for r in audit.collect()} == {"in_both": 19_998, "missing_in_index": 2, "orphan": 1}
    moved = mails.filter(M.audit_bucket("id", M.AUDIT_BUCKETS).isin(unequal)).count()
    assert moved < 100
    assert {r.state: r["count"] for r in M.index_audit(mails, mails).collect()} == {"in_both": 20_000}
    assert M.index_audit(mails.limit(0), mails.limit(0)).count() == 0
    assert {r.state: r["count"] for r in M.index_audit(mails.limit(0), spark.range(3)).collect()} == {"orphan": 3}


def test_exact_terms(spark, mails, tmp_path):
    rows = spark.createDataFrame([(1, "a", "m1", "x@y", ["r@y", "r@y", "s@y"], None, "Whole Subject"), (2, None, None, None, [], ["r@y"], "s" * 1025)],
                                 "id long, archive_id string, message_id string, sender string, receivers array<string>, cc array<string>, subject string")
    K.write_exact_terms(rows, str(tmp_path / "e"))
    exact = spark.read.parquet(str(tmp_path / "e" / "exact"))
    find = lambda field, value: sorted(r.id for r in K.with_exact_term(exact, field, value).collect())
    assert find("receivers", "r@y") == [1] and find("cc", "r@y") == [2] and find("subject.exact", "Whole Subject") == [1]
    assert find("subject.exact", "whole") == [] and find("subject.exact", "s" * 1025) == [] and find("id", "2") == [2] and find("message_id", "m1") == [1]
    plan = K.with_exact_term(exact, "cc", "r@y")._jdf.queryExecution().executedPlan().toString()
    assert "term_bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
