"""Keyword-search queries.

Searches run on an index that is built once per session and table folder, as in use; the queries named after
building steps compute those steps from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailweave.operators import keyword as K
from mailweave.operators import pruned_ranking
from mailweave.operators.browse import in_date_range
from mailweave.plans.browsing import DATE_FROM, DATE_TO, _ntz
from mailweave.plans.registry import query
from mailweave.session import files_stamp, scratch_path
from mailweave.sources.testmail import emails, threaded_emails

QUERY = "Topic 7 thereader@example.com tion"
MISSPELT = "topc 7 theer"
SENDER = "user12"
PAGE, PAGE_SIZE = 2, 15
DIGITS = 6

_indexes: dict[tuple, K.Index] = {}


def index(spark, sf) -> K.Index:
    """The stored index of a table folder, written and opened on first use in this application, and again when its files have changed."""
    key = (spark.sparkContext.applicationId, sf, files_stamp(spark, f"{sf}/documents.parquet", f"{sf}/events.parquet"))
    if key not in _indexes:
        folder = scratch_path(spark, "keyword-index")
        K.write_index(emails(spark, sf), folder)
        _indexes[key] = K.Index.read(spark, folder)
    return _indexes[key]


def _rounded(rows):
    return rows.withColumn("score", F.round("score", DIGITS))


@query
def kw_tokens(spark, sf):
    """Words of all bodies with their stem and count."""
    return K.tokens_with_terms(emails(spark, sf)).select("token", "term", "count")


@query
def kw_fold(spark, sf):
    words = K.tokens_with_terms(emails(spark, sf), stem=False)
    return words.groupBy("term").agg(F.sum("count").alias("count"), F.count("*").alias("spellings"))


@query
def kw_field_rows(spark, sf):
    return K.field_rows(emails(spark, sf))


@query
def kw_postings(spark, sf):
    return K.postings(emails(spark, sf))


@query
def kw_exact_terms(spark, sf):
    """The values of all exact fields, as the index has them."""
    folder = scratch_path(spark, "exact-terms")
    K.write_exact_terms(threaded_emails(spark, sf), folder)
    return spark.read.parquet(f"{folder}/exact").drop("term_bucket")


@query
def kw_vocab_df(spark, sf):
    return K.vocabulary(K.postings(emails(spark, sf))).select("field", "term", "df")


@query
def kw_field_stats(spark, sf):
    return K.field_stats(emails(spark, sf)).withColumn("avgdl", F.round("avgdl", DIGITS))


def _exact(spark, text=QUERY):
    return K.fixed(K.exact_terms(K.query_terms(K.one_query(spark, text))))


def _exact_scores(spark, sf, text=QUERY):
    stored, terms = index(spark, sf), _exact(spark, text)
    return K.field_scores(terms, K.pushed_down(terms, stored))


@query
def kw_bm25_field(spark, sf):
    return _rounded(_exact_scores(spark, sf)).select("id", "field", "score")


@query
def kw_best_fields(spark, sf):
    return _rounded(K.best_fields(_exact_scores(spark, sf))).select("id", "score")


@query
def kw_fuzzy_terms(spark, sf):
    """Index terms within the allowed edits of the words of a misspelt query."""
    terms = K.query_terms(K.one_query(spark, MISSPELT))
    return K.expand_request(terms, index(spark, sf).vocab).select(
        "field", "query_term", "term", F.round("weight", DIGITS).alias("weight"), F.col("edits").cast("bigint").alias("edits"))


def subject_queries(spark, sf):
    """Every distinct normalised subject as a query."""
    from mailweave.functions.headers import normalized_subject

    texts = emails(spark, sf).select(normalized_subject(F.col("subject")).alias("query")).filter("query <> ''").distinct()
    return texts.select(F.xxhash64("query").alias("query_id"), "query")


@query
def kw_fuzzy_search(spark, sf):
    """Many fuzzy queries in one job: the ten best mails for every subject of the archive."""
    stored, queries = index(spark, sf), subject_queries(spark, sf)
    terms = K.expand_fuzzy(K.query_terms(queries), stored.vocab)
    scores = _rounded(pruned_ranking.best_per_query(terms, stored, 10))
    return K.ranked_per_query(scores, 10).join(queries, "query_id").select(
        "query", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query
def kw_sender_filter(spark, sf):
    return K.sender_filter(index(spark, sf), SENDER)


@query
def kw_page_total(spark, sf):
    """One page of hits next to the exact number of all hits."""
    scores = _rounded(K.best_fields(_exact_scores(spark, sf)))
    page = K.ranked(scores, PAGE_SIZE, (PAGE - 1) * PAGE_SIZE).select("id", "score")
    total = scores.agg(F.count("*").alias("total"))
    return page.unionByName(total, allowMissingColumns=True)


def search_scores(spark, sf, text, sender=None, date_from=None, date_to=None):
    """A request's scores and terms: fuzzy terms, ranking, filters.  Filters do not change scores."""
    stored = index(spark, sf)
    terms = K.fixed(K.expand_request(K.query_terms(K.one_query(spark, text)), stored.vocab))
    scores = _rounded(K.best_scores(terms, K.pushed_down(terms, stored)))
    if sender:
        scores = scores.join(K.sender_filter(stored, sender), "id", "left_semi")
    if date_from is not None or date_to is not None:
        dated = emails(spark, sf).filter(in_date_range(date_from, date_to)).select("id")
        scores = scores.join(dated, "id", "left_semi")
    return scores, terms


def whole_hits(spark, sf, scores, terms, text, limit, offset=0):
    """One page of hits with their mail's data, marked excerpt and the number of all hits, best first.

    Hits whose mail is gone stay, without its data.
    """
    page, total = K.page_and_total(scores, limit, offset)
    found = K.look_up(emails(spark, sf), page, "subject", "sender", "sent_at", "summary", "body_text")
    marked = K.highlight(page, found, terms, K.one_query(spark, text))
    shown = found.select("id", "subject", "sender", "sent_at", "summary")
    return marked.join(shown, "id", "left").withColumn("total", F.lit(total).cast("bigint")).orderBy(F.desc("score"), "id")


@query
def kw_search(spark, sf):
    scores, terms = search_scores(spark, sf, QUERY, SENDER[:5], _ntz(DATE_FROM), _ntz(DATE_TO))
    hits = whole_hits(spark, sf, scores, terms, QUERY, 20)
    return hits.select("id", "subject", "sender", "sent_at", "summary", "snippet", "score", "total")


@query
def kw_highlight(spark, sf):
    """The first page of a fuzzy search with marked excerpts."""
    scores, terms = search_scores(spark, sf, QUERY)
    return whole_hits(spark, sf, scores, terms, QUERY, 20).select("id", "score", "snippet")
