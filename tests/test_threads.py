"""Threads: seed rows, brute-force roots, long threads, hot keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mailweave.operators import analytics as A
from mailweave.operators import browse as B
from mailweave.operators import threads as T

FIELDS = ("id long, archive_id string, message_id string, in_reply_to string, references_header string, sender string, "
          "receivers array<string>, cc array<string>, subject string, body_text string, sent_at timestamp_ntz, "
          "created_at timestamp_ntz")
DAY = datetime(2024, 1, 1)


def mail(i, subject="S", mid="auto", parent=None, refs=None, sender="a@x", to=("b@x",), cc=(), body="text", day=0):
    mid = f"m{i}" if mid == "auto" else mid
    sent = None if day is None else DAY + timedelta(days=day)
    return (i, "arc", mid, parent, refs, sender, list(to), list(cc), subject, body, sent, DAY + timedelta(seconds=i))


def frame(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


def test_seed_conversation(spark):
    rows = frame(spark, [
        mail(1, "Q1 Planning Meeting", sender="alice@x", to=("bob@x", "carol@x"), day=0),
        mail(2, "Re: Q1 Planning Meeting", sender="bob@x", to=("alice@x", "carol@x"), day=1)])
    stats = T.thread_stats(T.with_subject_thread(rows)).collect()
    assert [(r.subject_normalized, r.participant_count, r.email_count, r.root_message_id) for r in stats] == [
        ("Q1 Planning Meeting", 3, 2, "m1")]
    assert T.threads_by_header(rows).count() == 2


def test_undated_mail_comes_first_and_empty_subject_falls_back(spark):
    rows = frame(spark, [mail(1, "Re:", day=3, parent="x"), mail(2, "", day=None, mid=None, parent="y"), mail(3, "", day=5, cc=("", ))])
    row = T.thread_stats(T.with_subject_thread(rows)).first()
    assert (row.subject_normalized, row.root_message_id, row.email_count) == ("archive-arc", "m3", 3)
    assert (row.first_email_at, row.last_email_at) == (DAY + timedelta(days=3), DAY + timedelta(days=5))
    rootless = frame(spark, [mail(1, day=None, mid=None, parent="p"), mail(2, day=1, parent="q")])
    assert T.thread_roots(T.with_subject_thread(rootless)).first().root_message_id is None


def brute_keys(rows):
    known = {r[2] for r in rows if r[2]}
    keys = {}
    for r in rows:
        refs = [x.strip("<>") for x in (r[4] or "").split()]
        root = next((x for x in refs if x in known), None)
        if not root:
            root = r[3] if r[3] in known else r[2]
        if root:
            keys[r[0]] = "msg:" + root
        elif r[8]:
            keys[r[0]] = "subject:" + r[8].removeprefix("Re: ")
    return keys


def test_global_keys_match_brute_force_also_when_a_parent_is_hot(spark):
    pick = random.Random(5)
    rows = []
    for i in range(400):
        parent = "m0" if i % 3 == 0 else pick.choice([None, f"m{pick.randrange(500)}"])
        refs = pick.choice([None, None, f"<m{pick.randrange(600)}> <m{pick.randrange(400)}>", "<gone@x>"])
        mid = None if pick.random() < .2 else f"m{i}"
        rows.append(mail(i, pick.choice(["", "A", "Re: A", "B"]), mid=mid, parent=parent, refs=refs))
    data = frame(spark, rows)
    want = brute_keys(rows)
    for hot_rows in (10, 10**6):
        got = {r.id: r.thread_key for r in T.with_global_thread_key(data, hot_rows).collect()}
        assert len(got) == 400
        assert {k: v for k, v in got.items() if v} == want
    parents = {r.id: r.parent_id for r in T.reply_parents(data, 10).collect()}
    known = {r[2] for r in rows if r[2]}
    assert parents == {r[0]: r[3] if r[3] in known else None for r in rows}


def test_summary_of_a_long_thread_is_exact(spark):
    rows = [mail(i, "", body="" if i < 700 else f"Body {i}. more", day=i % 50) for i in range(1500)]
    rows += [mail(10_000 + i, "Short", body=f"First {i}. Second", day=i) for i in range(3)] + [mail(20_000, "Alone")]
    data = T.with_subject_thread(frame(spark, rows)).withColumn("k", F.col("thread_key"))
    got = {r.thread_key: r.summary for r in T.thread_summaries(data, ("thread_key",)).collect()}

    def plain(group):
        ordered = sorted(group, key=lambda r: (r[10], r[11], r[0]))
        text = "Thread conversation. " + " | ".join(f"{r[8]}: {r[9]}" for r in ordered).strip()
        text = text if len(text) <= 3000 else text[:2997].rstrip() + "..."
        parts = [p.strip() for p in text.split(".") if p.strip()][:2]
        out = ". ".join(parts)
        out = out[:247].rstrip() + "..." if len(out) > 250 else out
        return out if out.endswith(".") else out + "."

    assert set(got) == {"archive-arc", "Short"}
    assert got["archive-arc"] == plain(rows[:1500])
    assert got["Short"] == plain(rows[1500:1503])


def test_each_mail_has_one_thread_and_buckets_add_up(spark, sf):
    from mailweave.plans.tables import threads
    from mailweave.sources.testmail import threaded_emails

    mails, all_threads = threaded_emails(spark, sf), threads(spark, sf)
    assert all_threads.agg(F.sum("email_count")).first()[0] == mails.count()
    dist = {r.bucket: r["count"] for r in A.thread_size_distribution(all_threads).collect()}
    assert set(dist) == {"1", "2-5", "6-10", "11+"} and sum(dist.values()) == all_threads.count()
    empty = A.thread_size_distribution(all_threads.limit(0)).collect()
    assert [(r.bucket, r["count"]) for r in empty] == [("1", 0), ("2-5", 0), ("6-10", 0), ("11+", 0)]


def test_salted_lookup_equals_plain_join(spark, sf):
    from mailweave.plans.tables import threads
    from mailweave.sources.testmail import threaded_emails

    mails = threaded_emails(spark, sf).select("id", "thread_id").withColumn(
        "thread_id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("thread_id")))
    heads = threads(spark, sf).unionByName(threads(spark, sf).limit(1).withColumn("id", F.lit("hot")))
    salted = sorted(map(str, B.with_thread(mails, heads, hot_rows=5).collect()))
    plain = sorted(map(str, mails.join(heads.select(
        F.col("id").alias("thread_id"), F.col("subject_normalized").alias("thread_subject")), "thread_id", "left").select(
        "thread_id", "id", "thread_subject").collect()))
    assert len(salted) == len(plain) and salted == plain


def test_match_or_create(spark):
    existing = spark.createDataFrame([("t1", "A", "r1"), ("t0", "A", None), ("t2", "B", "r2")],
                                     "id string, subject_normalized string, root_message_id string")
    groups = spark.createDataFrame([("A", "r2"), ("A", None), ("C", "r9"), ("C", None)],
                                   "subject_normalized string, root_message_id string")
    got = T.match_or_create(groups, existing).collect()
    assert sorted((r.subject_normalized, r.root_message_id or "", r.matched_by) for r in got) == [
        ("A", "", "subject"), ("A", "r2", "root"), ("C", "", "new"), ("C", "r9", "new")]
    assert {r.thread_id for r in got if r.matched_by == "root"} == {"t2"}
    assert {r.thread_id for r in got if r.matched_by == "subject"} == {"t0"}
    assert len({r.thread_id for r in got if r.matched_by == "new"}) == 1


def test_new_groups_of_one_root_share_a_thread(spark):
    existing = spark.createDataFrame([("t1", "A", "r1")], "id string, subject_normalized string, root_message_id string")
    groups = spark.createDataFrame([("X", "r9"), ("Y", "r9"), ("Y", None), (None, None)], "subject_normalized string, root_message_id string")
    got = {(r.subject_normalized, r.root_message_id): (r.thread_id, r.matched_by) for r in T.match_or_create(groups, existing).collect()}
    assert got["X", "r9"][0] == got["Y", "r9"][0] != got["Y", None][0]
    assert (got["X", "r9"][1], got["Y", "r9"][1], got["Y", None][1]) == ("new", "root", "new") and len(got) == 4


def test_dashboard_payload(spark, sf):
    from mailweave.plans.tables import archives, threads
    from mailweave.sources.testmail import emails

    row = A.dashboard(emails(spark, sf), threads(spark, sf), archives(spark, sf)).first()
    assert row.overview.total_emails == emails(spark, sf).count()
    assert len(row.top_senders) == 10 and row.top_senders[0]["count"] >= row.top_senders[-1]["count"]
    days = [d.date for d in row.daily_volume]
    assert days == sorted(days) and len(days) <= 30
    assert set(row.thread_size_distribution) == {"1", "2-5", "6-10", "11+"}


def test_progress(spark):
    rows = spark.createDataFrame([("a", "completed", 0, 0), ("b", "failed", 0, 0), ("c", "processing", 8, 1)],
                                 "id string, status string, total_emails long, processed_emails long")
    assert {r.id: r.progress for r in A.archive_progress(rows).collect()} == {"a": 100, "b": 0, "c": 13}


def test_nested_order_of_thread_rows(spark):
    rows = T.with_subject_thread(frame(spark, [mail(1, day=2), mail(2, day=None), mail(3, day=1)])).withColumn(
        "summary", F.lit("s"))
    heads = T.thread_stats(rows).withColumnRenamed("thread_id", "id")
    assert [r.email_id for r in B.threads_with_emails(heads, rows).collect()] == [2, 3, 1]
    single = [r.email_id for r in B.threads_with_emails(heads, rows, single_order=True).collect()]
    assert single == [2, 3, 1]  # the undated mail stands at its creation time, 2024-01-01
