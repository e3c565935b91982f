"""The best hits of many queries at once without scoring every mail that has any of their words.

Every term's part of a score has an upper bound, from its weight and from the largest count and shortest text among its postings, which
the vocabulary keeps.  The strongest terms of a query, few postings in all, give its running n-th best score first.  In each field
the weakest terms, as many as cannot reach that score together, are optional: a mail that has no other term of the field
cannot be among the best through it.  So only the postings of the other, essential terms are joined with the queries; what they
find is cut again by what the optional terms could add; and for the mails that are left the optional terms are looked up by term
and mail.  The result equals that of scoring everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.operators.keyword import BOOSTS, K1, B, Index, in_folders, term_bucket
from mailweave.operators.skew import first_n_per_key
from mailweave.session import materialise

SEED_POSTINGS = 256  # postings of a query's strongest terms before no further term is added to them
LISTED_TERMS = 100_000  # distinct terms of a batch that every task can hold
SLACK = 2e-6  # scores this close may be ranked alike after rounding


def term_part(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's count adds to the score, before its weight: it rises with the count and falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weighted_terms(terms: DataFrame, index: Index) -> DataFrame:
    """``(query_id, field, term, df, weight, avgdl, bound)``: weights hold idf and the field's boost; no posting adds more than ``bound``."""
    boost = F.create_map(*[F.lit(x) for pair in BOOSTS.items() for x in pair])
    repeated = terms.groupBy("query_id", "field", "term").agg(F.sum("weight").alias("weight"))
    df, n = F.col("df"), F.col("n")
    weight = F.col("weight") * F.log1p((n - df + 0.5) / (df + 0.5)) * boost[F.col("field")]
    rows = repeated.join(index.vocab, ["field", "term"]).join(index.stats, "field")
    return rows.select("query_id", "field", "term", "df", weight.alias("weight"), "avgdl",
                       (weight * term_part(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))).alias("bound"))


def postings_of(terms: DataFrame, index: Index) -> DataFrame:
    """The postings of a batch's terms: folders that hold none of them are not read, and all other postings end in the scan, before a join moves them.

    Only beyond ``LISTED_TERMS`` terms, whose postings are a large part of all, a shuffle brings both sides together.
    """
    listed = terms.select("field", "term").distinct()
    # No more than TERM_BUCKETS numbers, however many terms there are.
    buckets = {r.b for r in listed.select(term_bucket(F.col("term")).alias("b")).distinct().collect()}
    found = in_folders(index.postings, buckets)
    if listed.limit(LISTED_TERMS + 1).count() > LISTED_TERMS:
        return found
    return found.join(F.broadcast(listed), ["field", "term"], "left_semi")


def parts(weighted: DataFrame, index: Index) -> DataFrame:
    """``(query_id, id, field, part)``: the postings of each query's terms, scored."""
    listed = weighted.select("query_id", "field", "term", "weight", "avgdl")
    part = F.col("weight") * term_part(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return postings_of(listed, index).join(listed, ["field", "term"]).select("query_id", "id", "field", part.alias("part"))


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id", "id", "field").agg(F.sum("part").alias("part"))


def nth_best(field_sums: DataFrame, n: int) -> DataFrame:
    """``(query_id, reached)``: the ``n``-th best of the mails seen so far; queries that have seen fewer are left out."""
    best = field_sums.groupBy("query_id", "id").agg(F.max("part").alias("part"))
    ranked = first_n_per_key(best, ["query_id"], [F.desc("part")], n, "id")
    return ranked.filter(F.col("rank") == n).select("query_id", F.col("part").alias("reached"))


def seeds(weighted: DataFrame) -> DataFrame:
    """The strongest terms of each query, until their postings are ``SEED_POSTINGS``; one term at least."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "field", "term")
    before = F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return weighted.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < SEED_POSTINGS).drop("before")


def split(weighted: DataFrame, reached: DataFrame) -> DataFrame:
    """``weighted`` with ``optional``: the weakest terms of a field, as many as stay below the query's n-th best score together."""
    order = Window.partitionBy("query_id", "field").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = weighted.join(reached, "query_id", "left")
    return rows.withColumn("optional", F.coalesce(F.sum("bound").over(order) < F.col("reached") - SLACK, F.lit(False)))


def candidates(split_terms: DataFrame, index: Index, n: int) -> DataFrame:
    """``(query_id, id, field, part)``: sums of the essential terms, of mails that may still be among the ``n`` best."""
    found = materialise(_sums(parts(split_terms.filter("not optional"), index)), "essential-scores")
    rest = split_terms.groupBy("query_id", "field").agg(F.sum(F.when(F.col("optional"), F.col("bound"))).alias("rest"))
    open_ = F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("reached", F.lit(0.0)) - SLACK
    # By now the n-th best is known better.
    return found.join(rest, ["query_id", "field"], "left").join(nth_best(found, n), "query_id", "left").filter(open_).select(
        "query_id", "id", "field", "part")


def looked_up(kept: DataFrame, split_terms: DataFrame, index: Index) -> DataFrame:
    """``(query_id, id, field, part)`` of the optional terms in the mails that are left."""
    optional = split_terms.filter("optional")
    wanted = kept.select("query_id", "field", "id").join(optional, ["query_id", "field"]).select(
        "query_id", "id", "field", "term", "weight", "avgdl")
    part = F.col("weight") * term_part(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return postings_of(optional, index).join(wanted, ["field", "term", "id"]).select("query_id", "id", "field", part.alias("part"))


def best_per_query(terms: DataFrame, index: Index, n: int) -> DataFrame:
    """``(query_id, id, score)``: of every query at least its ``n`` best mails, scored in full; few others.

    ``terms``: (query_id, field, term, weight), any number of queries.  Rank what comes back by score, rounded to six digits or not.
    """
    weighted = materialise(weighted_terms(terms, index), "query-terms")
    reached = nth_best(_sums(parts(seeds(weighted), index)), n)
    split_terms = materialise(split(weighted, reached).drop("reached"), "query-terms")
    kept = materialise(candidates(split_terms, index, n), "candidates")
    scores = _sums(kept.unionByName(looked_up(kept, split_terms, index)))
    return scores.groupBy("query_id", "id").agg(F.max("part").alias("score"))
