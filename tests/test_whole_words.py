"""Terms that workers make from whole lists of words, against the expressions for one word; requests that work out no more than asked."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailweave.functions.analysis import fold, term_of, tokens, with_stem
from mailweave.operators import keyword as K
from mailweave.operators import skew
from mailweave.operators import vectors as V
from mailweave.sources import archives as S

WORDS = ["caresses", "ponies", "agreed", "hopping", "falling", "filing", "happy", "sky", "syzygy", "yy", "relational", "rationalize",
         "adoption", "replacement", "controll", "rate", "cease", "straße", "cafés", "œuvres", "cafés", "3,5", "o'neil's", "漢", "a", "is"]


def _mails(spark, rows):
    return spark.createDataFrame(rows, "id long, subject string, body_text string, summary string, sender string")


def test_term_of_one_word_is_the_expression(spark):
    rows = with_stem(spark.createDataFrame([(w,) for w in WORDS], "token string"), "token").withColumn("folded", fold(F.col("token"))).collect()
    assert [(r.term, r.folded) for r in rows] == [(term_of(r.token), term_of(r.token, False)) for r in rows]


@pytest.mark.parametrize("block", [3, 1 << 19])
def test_counts_do_not_depend_on_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_TOKENS", block)
    mails = _mails(spark, [(i, "Cats cat", " ".join(WORDS[i:] * 2), "", None) for i in range(len(WORDS))]).coalesce(1)
    found = {(r.id, r.field, r.term): (r.tf, r.dl) for r in K.token_rows(mails).collect()}
    expected = {}
    for r in mails.select("id", tokens(F.col("body_text")).alias("words")).collect():
        expected |= {(r.id, "body_text", t): (n, len(r.words)) for t, n in Counter(map(term_of, r.words)).items()}
        expected[r.id, "subject", "cat"] = 2, 2
    assert found == expected
    heads = K.token_rows(mails).filter("head").groupBy("id", "field").count().collect()
    assert len(heads) == 2 * len(WORDS) and all(r["count"] == 1 for r in heads)


def test_no_shuffle_unless_ids_repeat(spark):
    plan = lambda rows: K.token_rows(_mails(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan([(1, "a b", "", "", None), (2, "a b", "", "", None)])
    twice = K.token_rows(_mails(spark, [(1, "a b", "", "", None), (1, "a c", "", "", None), (None, "a", "", "", None), (None, "a", "", "", None)]))
    assert {(r.id, r.term): r.tf for r in twice.collect()} == {(1, "a"): 2, (1, "b"): 1, (1, "c"): 1, (None, "a"): 2}


def test_spread_runs_nothing(spark):
    """A plan with an exchange is counted without running it: this one cannot be run."""
    fails = spark.range(10).select(F.raise_error(F.lit("was run")).cast("string").alias("k"), "id").groupBy("k").agg(F.max("id").alias("id"))
    assert skew.planned_partitions(fails) == 8


def test_few_words_are_tested_in_full(spark):
    """Only words within reach get the whole distance: one swap or edit of a short word."""
    vocab = spark.createDataFrame([("body_text", t, 1) for t in ("topc", "topic", "tpoc", "abcd", "cpot", "to", "topcs")], "field string, term string, df long")
    terms = spark.createDataFrame([(0, "body_text", 0, "topc")], "query_id long, field string, pos int, term string")
    assert {r.term: r.edits for r in K.expand_request(terms, vocab).collect()} == {"topc": 0, "topic": 1, "tpoc": 1, "topcs": 1}


def test_recommendations_work_out_no_other_mail(spark):
    trap = F.when(F.col("id") > 2, F.raise_error(F.lit("worked out")).cast("string")).otherwise(F.lit("s"))
    mails = spark.range(6).select("id", F.lit("t").alias("subject"), F.lit("x").alias("sender"), F.lit(None).cast("timestamp").alias("sent_at"), trap.alias("summary"))
    near = spark.createDataFrame([(1, 0.5), (9, 0.4)], "id long, similarity_score double")
    assert [(r.id, r.summary) for r in V.recommendations(near, mails).collect()] == [(1, "s")]


def test_messages_are_decoded_some_bytes_at_a_time(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(S, "CHUNK_BYTES", 100)
    held, framed = [], S.frame
    monkeypatch.setattr(S, "frame", lambda rows, columns: held.append(len(rows)) or framed(rows, columns))
    rows = [(i, b"Subject: s%d\r\n\r\n" % i + b"x" * 60) for i in range(50)]
    batches = []

    class Given:
        def select(self, *names):
            return spark.createDataFrame(rows, "id long, raw binary").select(*names)

    monkeypatch.setattr(S, "spread", lambda frame, key: type("Frame", (), {"mapInPandas": lambda self, run, schema: batches.append(run)})())
    S.parse_messages(Given())
    import pandas as pd
    out = pd.concat(list(batches[0]([pd.DataFrame(rows, columns=["id", "raw"])])))
    assert list(out["subject"]) == [f"s{i}" for i in range(50)] and list(out["id"]) == list(range(50))
    assert len(held) > 20 and max(held) <= 2
