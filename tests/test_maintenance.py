"""Upserts, deletes, audits, lookups and pages."""

import pytest
from pyspark.sql import functions as F

from mailweave.operators import browse as B
from mailweave.operators import maintenance as M
from mailweave.operators.skew import first_n_per_key, hot_keys, lookup_join, spread_nulls
from mailweave.schema import EMAILS, contract_problems, overlong_values


def ids(frame, column="id"):
    return sorted(r[column] for r in frame.collect())


def test_upsert_twice_is_upsert_once(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, version int")
    delta = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, version int")
    once = M.upsert(base, delta)
    assert sorted(map(tuple, once.collect())) == [(1, "a", 0), (2, "d", 2), (3, "e", 1)]
    assert sorted(map(tuple, M.upsert(once, delta).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, M.insert_if_absent(base, M.latest_by_id(delta, "id", "version")).collect())) == [
        (1, "a", 0), (2, "b", 0), (3, "e", 1)]


def test_delete_then_audit_finds_no_orphans(spark):
    mails = spark.range(10).withColumn("thread_id", F.col("id") % 3)
    gone = mails.filter("id < 4")
    left, index = M.delete_rows(mails, gone, "id"), M.delete_rows(mails.select("id"), gone, "id")
    assert {r.state: r["count"] for r in M.index_audit(left, index).collect()} == {"in_both": 6}
    partial = {r.state: r["count"] for r in M.index_audit(left, mails.filter("id < 6").select("id")).collect()}
    assert partial == {"in_both": 2, "missing_in_index": 4, "orphan": 4}
    cleared = M.clear_thread(mails, spark.createDataFrame([(1,)], "thread_id long"))
    assert cleared.count() == 10 and ids(cleared.filter("thread_id is null")) == [1, 4, 7]


def test_lookup_keeps_request_order(spark):
    rows = spark.range(100)
    assert [r.id for r in B.by_ids_in_order(rows, [5, 1, 1000, 3, 5]).collect()] == [5, 1, 3]


def test_sender_condition(spark):
    rows = spark.createDataFrame([("a_b@x",), ("aXb@x",), ("50%@x",)], "sender string")
    assert ids(rows.filter(B.sender_condition("A_B")), "sender") == ["a_b@x"]
    assert ids(rows.filter(B.sender_condition("a_b", escape=False)), "sender") == ["aXb@x", "a_b@x"]


def test_pages(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"2024-01-{i:02d}") for i in range(1, 12)], "id long, d string")
    rows = rows.withColumn("sent_at", F.col("d").cast("timestamp_ntz")).withColumn("created_at", F.col("sent_at"))
    pages = [[r.id for r in B.email_page(rows, p, 4).collect()] for p in (1, 2, 3, 4)]
    assert pages == [[11, 10, 9, 7], [6, 5, 3, 2], [1, 4, 8], []]
    with pytest.raises(ValueError):
        B.email_page(rows, 0, 4)
    assert tuple(B.page_totals(rows, 4).first()) == (11, 4, 3)
    assert tuple(B.page_totals(rows.limit(0), 4).first()) == (0, 4, 0)


def test_first_n_per_key_is_whole_per_key_and_salted(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    got = first_n_per_key(rows, ["k"], [F.desc("id")], 7, "id").collect()
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append(r.id)
    assert {(r.k, r.id, r["rank"]) for r in got} == {
        (k, i, n + 1) for k, v in want.items() for n, i in enumerate(sorted(v, reverse=True)[:7])}
    assert [r.k for r in hot_keys(rows, "k", 1000).collect()] == [0]


def test_contract(spark):
    empty = spark.createDataFrame([], EMAILS)
    rows = contract_problems(spark, {"emails": empty.drop("cc").withColumn("sender", F.lit(1))}).collect()
    assert {(r["table"], r["column"]) for r in rows} == {
        ("email_archives", ""), ("email_threads", ""), ("emails", "cc"), ("emails", "sender")}
    long = spark.createDataFrame([("1", "s" * 1025, "a"), ("2", "s" * 1024, "b")], "id string, subject string, sender string")
    assert [tuple(r) for r in overlong_values(long).collect()] == [("1", "subject", 1025)]


def test_edge_cases_of_versions_and_new_rows(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id long, v string, version int")
    delta = spark.createDataFrame([(1, "lost", None), (1, "kept", 3), (2, "first", None), (3, "x", 2), (3, "x", 2)], "id long, v string, version int")
    assert sorted((r.id, r.v) for r in M.upsert(base, delta).collect()) == [(1, "kept"), (2, "first"), (3, "x")]
    new = spark.createDataFrame([(3, "p", 0), (3, "q", 0), (1, "no", 0)], "id long, v string, version int")
    rows = [(r.id, r.v) for r in M.insert_if_absent(base, new).collect()]
    assert sorted(i for i, _ in rows) == [1, 2, 3] and (1, "a") in rows


def test_many_hot_keys_and_null_keys_are_spread(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 1500).alias("k"), "id")
    names = spark.range(1500).select(F.col("id").alias("k"), F.lit("n").alias("name"))
    assert hot_keys(rows, "k", 10).count() > 900
    joined = lookup_join(rows, names, "k", "id", hot_rows=10)
    assert joined.count() == 60_000 and joined.filter("name is null").count() == 20_000
    placed = rows.withColumn("k", F.lit(None).cast("string")).withColumn("_row", F.col("id"))
    sizes = placed.repartition(8, spread_nulls("k", "_row")).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 60_000 / 8


def test_pages_by_the_last_row_equal_pages_by_offset(spark):
    rows = spark.range(60).select("id", F.when(F.col("id") % 5 > 0, F.make_timestamp(F.lit(2024), F.lit(1), (F.col("id") % 4 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)))
                                  .alias("sent_at"), F.make_timestamp(F.lit(2024), F.lit(2), (F.col("id") % 3 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"))
    last = None
    for page in range(1, 8):
        want = [r.id for r in B.email_page(rows, page, 10).collect()]
        found = B.email_page(rows, 1, 10) if last is None else B.email_page_after(rows, last.sent_at, last.created_at, last.id, 10)
        got = found.collect()
        assert [r.id for r in got] == want
        last = got[-1] if got else last
