"""The pruned ranking of many queries gives what scoring everything gives, from far fewer pairs."""

import random

import pytest
from pyspark.sql import functions as F

from mailweave.operators import keyword as K
from mailweave.operators import pruned_ranking as P
from mailweave.session import materialise


@pytest.fixture(scope="module")
def corpus(spark):
    pick = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]  # few words are in nearly every mail
    rows = [(i, " ".join(pick.choices(words, weights, k=pick.randint(1, 4))), " ".join(pick.choices(words, weights, k=pick.randint(0, 60))), None,
             f"user{i % 9}@example.com") for i in range(1500)]
    rows += [(2000 + i, "w3 w1", "w3 w1 w0", None, "same@example.com") for i in range(50)]  # ties
    mails = spark.createDataFrame(rows, "id long, subject string, body_text string, summary string, sender string")
    built = K.Index.of(mails)
    return K.Index(materialise(built.postings, "test"), materialise(built.vocab, "test"), materialise(built.stats, "test"))


@pytest.fixture(scope="module")
def queries(spark):
    pick = random.Random(12)
    texts = [" ".join(f"w{min(399, int(pick.expovariate(0.02)))}" for _ in range(pick.randint(1, 6))) for _ in range(60)]
    texts += ["w0", "w0 w1 w2", "w399 w398", "w3 w1", "nothing here", "user3@example.com"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def ranked(scores, n):
    return sorted((r.query_id, r["rank"], r.id, r.score) for r in K.ranked_per_query(scores.withColumn("score", F.round("score", 6)), n).collect())


@pytest.mark.parametrize("n", [1, 10])
def test_equals_scoring_everything(spark, corpus, queries, n):
    terms = K.exact_terms(K.query_terms(queries))
    assert ranked(P.best_per_query(terms, corpus, n), n) == ranked(K.best_scores(terms, corpus), n)


def test_equals_scoring_everything_with_fuzzy_terms(spark, corpus, queries):
    terms = materialise(K.expand_fuzzy(K.query_terms(queries.filter("query_id % 5 = 0")), corpus.vocab), "test")
    assert ranked(P.best_per_query(terms, corpus, 10), 10) == ranked(K.best_scores(terms, corpus), 10)


def test_few_pairs_are_scored(spark, corpus, queries):
    terms = K.exact_terms(K.query_terms(queries))
    weighted = materialise(P.weighted_terms(terms, corpus), "test")
    every = P.parts(weighted, corpus).count()
    split = materialise(P.split(weighted, P.nth_best(P._sums(P.parts(P.seeds(weighted), corpus)), 10)).drop("reached"), "test")
    joined = P.parts(P.seeds(weighted), corpus).count() + P.parts(split.filter("not optional"), corpus).count()
    kept = materialise(P.candidates(split, corpus, 10), "test")
    asked = kept.join(split.filter("optional"), ["query_id", "field"]).count()
    assert joined + asked < 0.5 * every, (joined, asked, every)


def shuffled_rows(spark, frame):
    """Rows that the exchanges of a plan write when no join is broadcast by size."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        frame = frame.select("*")
        frame.collect()
        total, open_ = 0, [frame._jdf.queryExecution().executedPlan()]
        while open_:
            node = open_.pop()
            written = node.metrics().get("shuffleRecordsWritten")
            total += written.get().value() if written.isDefined() else 0
            open_ += [node.children().apply(i) for i in range(node.children().size())]
        return total
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_postings_of_other_terms_are_not_moved(spark, corpus, queries):
    terms = K.exact_terms(K.query_terms(queries.filter("query = 'w399 w398'")))
    weighted = materialise(P.weighted_terms(terms, corpus), "test").withColumn("optional", F.lit(True))
    kept = corpus.postings.join(weighted.select("field", "term"), ["field", "term"]).select(
        F.lit(weighted.first().query_id).alias("query_id"), "id", "field").distinct()
    every = corpus.postings.count()
    assert P.looked_up(kept, weighted, corpus).count() > 0
    assert shuffled_rows(spark, P.looked_up(materialise(kept, "test"), weighted, corpus)) < every / 10
    assert shuffled_rows(spark, P.parts(weighted, corpus)) < every / 10


def test_bounds_hold(spark, corpus, queries):
    weighted = materialise(P.weighted_terms(K.exact_terms(K.query_terms(queries)), corpus), "test")
    part = F.col("weight") * P.term_part(F.col("tf"), F.col("dl"), F.col("avgdl"))
    assert corpus.postings.join(weighted, ["field", "term"]).filter(part > F.col("bound") + 1e-9).count() == 0


def test_no_queries_and_no_mails(spark, corpus, queries):
    terms = K.exact_terms(K.query_terms(queries))
    assert P.best_per_query(terms.limit(0), corpus, 10).count() == 0
    none = K.Index(corpus.postings.limit(0), corpus.vocab.limit(0), corpus.stats.limit(0))
    assert P.best_per_query(terms, none, 10).count() == 0
