"""Merged index parts: as many as the logarithm of the batches, the same answers, and safe repetition."""

import glob
import json
import os
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.operators import keyword as K
from mailweave.session import materialise
from mailweave.streaming import ingest
from mailweave.streaming.parts import FAN, Parts, size_class


def batch_mails(spark, b, n=4):
    rows = [(b * n + i, f"topic {b % 5}", f"words common{i} rare{b} budget review", "", f"user{(b + i) % 7}@example.com") for i in range(n)]
    return spark.createDataFrame(rows, "id long, subject string, body_text string, summary string, sender string")


@pytest.fixture(scope="module")
def analysed(spark):
    """The postings of all batches, analysed in one job."""
    mails = reduce(DataFrame.unionByName, [batch_mails(spark, b) for b in range(50)])
    rows = K.posting_rows(mails).withColumn("term_bucket", F.pmod(K.term_bucket(F.col("term")), F.lit(2)))
    return materialise(rows.coalesce(2), "test")


def tables_of(analysed, b, n=4):
    rows = analysed.filter((F.col("id") >= b * n) & (F.col("id") < b * n + n)).coalesce(1)
    vocab = K.vocabulary(rows).withColumn("length", F.length("term"))
    return {"postings": rows, "vocab": vocab.coalesce(1), "field_stats": K.stat_parts(rows).coalesce(1)}


def scores(index, text):
    terms = K.fixed(K.exact_terms(K.query_terms(K.one_query(index.postings.sparkSession, text))))
    return sorted((r.id, round(r.score, 9)) for r in K.best_scores(terms, index).collect())


@pytest.fixture(scope="module")
def fifty(spark, analysed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("parts"))
    parts = Parts(spark, root)
    for b in range(50):
        parts.add(b, tables_of(analysed, b))
        parts.merge()
    return root


def built(analysed):
    """The index of one build over the postings of all batches."""
    return K.Index(analysed.drop("head", "term_bucket"), K.vocabulary(analysed), K.stats_from(K.stat_parts(analysed)))


def test_fifty_batches_leave_few_parts(spark, fifty):
    parts = Parts(spark, fifty)
    now = parts.manifest()["parts"]
    assert sorted(b for p in now.values() for b in p["batches"]) == list(range(50))
    per_class = {}
    for p in now.values():
        per_class[size_class(p["rows"])] = per_class.get(size_class(p["rows"]), 0) + 1
    assert max(per_class.values()) < FAN and len(now) <= 8
    for bucket in (0, 1):
        files = [f for folder in parts.folders("postings") for f in glob.glob(f"{folder}/term_bucket={bucket}/*.parquet")]
        assert 0 < len(files) <= 2 * len(now)
    # Folders that no longer count are gone, but for those of the last merge.
    assert len(os.listdir(os.path.join(fifty, "index", "parts"))) <= len(now) + FAN


def test_the_merged_index_is_that_of_one_build(spark, analysed, fifty):
    def index(root):
        p = Parts(spark, root)
        vocab = p.read("vocab").groupBy("field", "term", "length").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
        return K.Index(p.read("postings"), vocab, K.stats_from(p.read("field_stats")))

    stored, whole = index(fifty), built(analysed)
    for text in ("rare7 budget", "topic 3", "user3@example.com"):
        assert scores(stored, text) == scores(whole, text) != []
    columns = ["field", "term", "df", "max_tf", "min_dl"]
    assert sorted(map(tuple, stored.vocab.select(columns).collect())) == sorted(map(tuple, whole.vocab.select(columns).collect()))


def test_requests_cut_the_parts_before_adding_up(spark, fifty):
    parts = Parts(spark, fifty)
    vocab = parts.read("vocab").groupBy("field", "term", "length").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    expanded = K.expand_request(K.query_terms(K.one_query(spark, "rara7 budgot")), vocab)
    assert {r.term for r in expanded.collect()} >= {"budget", "rare7"}
    plan = expanded._jdf.queryExecution().optimizedPlan().toString().split("\n")
    low = next(i for i, line in enumerate(plan) if "Aggregate [field" in line)
    assert any("Filter" in line and "levenshtein" in line for line in plan[low + 1:])


def test_repeated_and_failed_batches(spark, analysed, tmp_path):
    root = str(tmp_path / "store")
    parts = Parts(spark, root)
    for b in (0, 1, 1, 2):
        if not parts.has(b):
            parts.add(b, tables_of(analysed, b))
    assert sorted(p["batches"] for p in parts.manifest()["parts"].values()) == [[0], [1], [2]]
    # A failure between writing a part and naming it: the folder does not count, and the repeated batch writes it over.
    parts._write(tables_of(analysed, 9)["postings"], "batch-3", "postings")
    os.makedirs(os.path.join(root, "index", "parts", "merged-left-over"))
    assert parts.read("postings").select("id").distinct().count() == 12 and not parts.has(3)
    parts.add(3, tables_of(analysed, 3))
    before = set(parts.folders("postings"))
    assert parts.merge() == 1 and parts.read("postings").select("id").distinct().count() == 16 and all(parts.has(b) for b in range(4))
    assert not os.path.exists(os.path.join(root, "index", "parts", "merged-left-over"))
    # What a reader may have begun to read is still there, until the next change.
    assert all(os.path.exists(f) for f in before)
    parts.add(4, tables_of(analysed, 4))
    assert not any(os.path.exists(f) for f in before)
    # Two writers: the second one of a version fails.
    stale = parts.manifest()
    parts._commit(stale, stale["parts"], [])
    with pytest.raises(RuntimeError, match="another writer"):
        parts._commit(stale, stale["parts"], [])


def test_merges_in_the_stream(spark, tmp_path):
    from tests.test_ingest import PLAIN

    root = str(tmp_path / "store")
    run = ingest.process_batch(root, ingest.Messages(), fan=2)
    for b in range(3):
        rows = [(10 * b + i, "a", f"{b}-{i}.eml", PLAIN.replace(b"one@x.org", f"m{b}{i}@x.org".encode())) for i in range(2)]
        batch = spark.createDataFrame(rows, "id long, archive_id string, source_file string, raw binary").withColumn("created_at", F.current_timestamp())
        run(batch, b)
        run(batch, b)
    parts = Parts(spark, root)
    assert len(parts.manifest()["parts"]) < 3 and json.dumps(parts.manifest())
    mails = ingest.read_table(spark, root, "emails")
    assert mails.count() == 6 and ingest.read_table(spark, root, "vectors").select("id").distinct().count() == 6
    stored, whole = ingest.stored_index(spark, root), K.Index.of(mails)
    assert sorted(map(str, stored.stats.collect())) == sorted(map(str, whole.stats.collect()))
    threads = ingest.current_threads(spark, root)
    assert threads.agg(F.sum("email_count")).first()[0] == 6 and threads.count() == mails.select("thread_id").distinct().count()
    assert {r.id for r in K.sender_filter(stored, "@").collect()} == {r.id for r in K.sender_filter(whole, "@").collect()} != set()
