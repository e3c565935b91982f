"""Keyword search: inverted index, ranking, fuzzy expansion, filters, pages and highlights.

The index is four plain tables.  ``postings(field, term, id, tf, dl)`` is written in term order, so a search reads
only the row groups of its terms; ``vocab(field, term, df, max_tf, min_dl)`` serves fuzzy expansion and bounds scores; ``field_stats(field, n, avgdl)``
has one row per field; ``grams(gram, term)`` finds distinct addresses by a part of them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.analysis import fold, surface_tokens, term_of, tokens, with_stem
from mailweave.functions.text import let, search_snippet
from mailweave.operators.address_search import grams_of, matching
from mailweave.operators.skew import first_n_per_key, spread
from mailweave.session import discard, materialise

# Fixed values of the ranking function and of the query (field weights, expansion limit).
K1, B = 1.2, 0.75
BOOSTS = {"subject": 4.0, "summary": 2.0, "body_text": 1.0, "sender_text": 1.0, "sender": 1.0}
ANALYSED = {"subject": "subject", "body_text": "body_text", "summary": "summary", "sender_text": "sender"}
EXACT_FIELD = "sender"
EXACT_COLUMNS = ("id", "archive_id", "thread_id", "message_id", "sender")
SUBJECT_CHARS = 1024
MAX_EXPANSIONS = 50
MAX_QUERY_CHARS, MAX_PAGE = 500, 100
TERM_BUCKETS = 256
BLOCK_TOKENS = 1 << 19  # words that a worker counts at once
BODY_FRAGMENT, SUMMARY_FRAGMENT = 150, 120


# ---- Building the index ------------------------------------------------------------------------------------

def field_rows(emails: DataFrame) -> DataFrame:
    """``(id, field, text)`` for the analysed fields; empty ones vanish."""
    pairs = F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(column).alias("text")) for field, column in ANALYSED.items()])
    return emails.select("id", F.inline(pairs)).filter(F.coalesce("text", F.lit("")) != "")


def counted(words: Column) -> Column:
    """``array<struct<token, tf>>`` of an array of words, counted inside the row: sorted, then cut where the word changes."""
    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
        cut = F.zip_with(starts, F.concat(F.slice(starts, 2, F.greatest(n, F.lit(1))), F.array(n + 1)),
                         lambda a, b: F.struct(F.get(ordered, a - 1).alias("token"), (b - a).cast("bigint").alias("tf")))
        return F.when(n > 0, F.filter(cut, lambda w: w["token"].isNotNull()))

    return let(F.sort_array(words), runs)


def token_rows(emails: DataFrame, stem: bool = True) -> DataFrame:
    """``(id, field, dl, term, tf, head)``: term counts of each analysed field with the field's length.

    Words are cut where their mail lies, and stemmed and counted by the workers next to it, which remember the stems of words they have
    met; neither texts nor counts are moved.  Only where ids come more than once a shuffle brings their counts together.  ``head`` marks
    one row for each field of a mail, so that lengths can be averaged from here.
    """
    placed = spread(emails.select("id", *dict.fromkeys(ANALYSED.values())), "id")
    lists = field_rows(placed).select("id", "field", tokens(F.col("text")).alias("tokens"))
    kind = emails.schema["id"].dataType.simpleString()
    terms = lists.mapInArrow(_count_terms(stem), f"id {kind}, field string, dl bigint, term string, tf bigint, head boolean")
    if not emails.groupBy("id").count().filter("count > 1").take(1):
        return terms
    return terms.groupBy("id", "field", "dl", "term").agg(F.sum("tf").alias("tf"), F.max("head").alias("head"))


def _count_terms(stem: bool):
    """Counts of each row's terms, some ``BLOCK_TOKENS`` words at a time."""
    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch["tokens"]).to_numpy(zero_copy_only=False))
            # Rows whose words end in the same block of words are counted together.
            cuts = np.flatnonzero(np.diff(ends // BLOCK_TOKENS)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(start, end - start)
                if len(part["tokens"].flatten()):
                    yield _counted_terms(part, stem)

    return run


def _counted_terms(part: pa.RecordBatch, stem: bool) -> pa.RecordBatch:
    lengths = pc.list_value_length(part["tokens"]).to_numpy(zero_copy_only=False).astype("int64")
    words = part["tokens"].flatten().dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False)
    named = pa.array([term_of(w, stem) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    term, count = named.indices.to_numpy(zero_copy_only=False).astype("int64"), len(named.dictionary)
    # Row and term in one number.
    found, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * count + term[codes], return_counts=True)
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    filled = np.flatnonzero(lengths)
    first = order[np.minimum.reduceat(rank[codes], (np.cumsum(lengths) - lengths)[filled])]
    head = np.zeros(len(found), bool)
    head[np.searchsorted(found, filled * count + term[first])] = True
    row = found // count
    return pa.RecordBatch.from_arrays(
        [part["id"].take(pa.array(row)), part["field"].take(pa.array(row)), pa.array(lengths[row]),
         named.dictionary.take(pa.array(found % count)), pa.array(tf.astype("int64")), pa.array(head)],
        ["id", "field", "dl", "term", "tf", "head"])


def posting_rows(emails: DataFrame, stem: bool = True) -> DataFrame:
    """Postings with ``head``: analysed terms, and the sender as one exact term of length one."""
    one = F.lit(1).cast("bigint")
    exact = emails.filter(F.col("sender").isNotNull()).select(
        F.lit(EXACT_FIELD).alias("field"), F.col("sender").alias("term"), "id", one.alias("tf"), one.alias("dl"), F.lit(True).alias("head"))
    return token_rows(emails, stem).select("field", "term", "id", "tf", "dl", "head").unionByName(exact)


def postings(emails: DataFrame, stem: bool = True) -> DataFrame:
    """The inverted index."""
    return posting_rows(emails, stem).drop("head")


def exact_terms_of(emails: DataFrame) -> DataFrame:
    """``(field, term, id)``: values that are found as a whole and are not analysed; a subject only up to ``SUBJECT_CHARS`` letters."""
    one = lambda name, value: F.struct(F.lit(name).alias("field"), F.array(value.cast("string")).alias("terms"))
    many = lambda name: F.struct(F.lit(name).alias("field"), F.array_distinct(F.coalesce(F.col(name), F.array().cast("array<string>"))).alias("terms"))
    subject = F.when(F.length("subject") <= SUBJECT_CHARS, F.col("subject"))
    fields = F.array(*[one(c, F.col(c)) for c in EXACT_COLUMNS if c in emails.columns], one("subject.exact", subject), many("receivers"), many("cc"))
    rows = emails.select("id", F.inline(fields)).select("field", F.explode("terms").alias("term"), "id")
    return rows.filter(F.col("term").isNotNull())


def write_exact_terms(emails: DataFrame, folder: str) -> None:
    """The exact terms in folders by term like the postings."""
    rows = exact_terms_of(emails).withColumn("term_bucket", term_bucket(F.col("term")))
    order = ("term_bucket", "field", "term", "id")
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("term_bucket")
     .parquet(os.path.join(folder, "exact")))


def with_exact_term(exact: DataFrame, field: str, value: str) -> DataFrame:
    """Ids of mails that have ``value`` in an exact field; reads one folder."""
    bucket = exact.sparkSession.range(1).select(term_bucket(F.lit(value)).alias("b")).first().b
    return in_folders(exact, {bucket}).filter((F.col("field") == field) & (F.col("term") == value)).select("id")


def vocabulary(posting_rows: DataFrame) -> DataFrame:
    """Document frequency per field and term, and what bounds a posting's score: the largest count and the shortest text."""
    return posting_rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def field_stats(emails: DataFrame) -> DataFrame:
    """Per field: number of mails that have it and their mean length.

    Counts words in the scan and shuffles one partial result per task.
    """
    analysed = field_rows(emails).select("field", F.size(tokens(F.col("text"))).cast("bigint").alias("dl"))
    exact = emails.filter(F.col("sender").isNotNull()).select(
        F.lit(EXACT_FIELD).alias("field"), F.lit(1).cast("bigint").alias("dl"))
    lengths = analysed.filter(F.col("dl") > 0).unionByName(exact)
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def stat_parts(rows: DataFrame) -> DataFrame:
    """``(field, n, words)`` of stored ``posting_rows``, by one head row for each field of a mail; parts of several tables add up."""
    return rows.filter("head").groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("words"))


def stats_from(parts: DataFrame) -> DataFrame:
    """``field_stats`` from parts."""
    return parts.groupBy("field").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))


def stats_without(postings: DataFrame) -> DataFrame:
    """``field_stats`` of stored postings that have lost mails."""
    lengths = postings.select("field", "id", "dl").distinct()
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def store_vocabulary(postings: DataFrame, folder: str) -> None:
    """Vocabulary in the order of word lengths, which is what fuzzy expansion cuts it by."""
    (vocabulary(postings).withColumn("length", F.length("term")).repartitionByRange("length", "field", "term")
     .sortWithinPartitions("length", "field", "term").write.mode("overwrite").parquet(os.path.join(folder, "vocab")))


def store_stats(stats: DataFrame, folder: str) -> None:
    stats.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, "field_stats"))


def store_grams(vocab: DataFrame, folder: str) -> None:
    """Trigrams of the distinct addresses, in their order."""
    (grams_of(vocab.filter(F.col("field") == EXACT_FIELD)).repartitionByRange("gram", "term").sortWithinPartitions("gram", "term")
     .write.mode("overwrite").parquet(os.path.join(folder, "grams")))


def write_index(emails: DataFrame, folder: str, stem: bool = True) -> None:
    """(Re)build the index tables below ``folder`` from one analysis of the mails.

    Postings lie in ``term_bucket`` folders, a hash of the term, and in term order within: a request reads the folders of its terms,
    however many these are.  A very common term spreads over many files of its folder.
    """
    spark = emails.sparkSession
    path = os.path.join(folder, "postings")
    # Three tables are made from what the analysis leaves.
    analysed = materialise(posting_rows(emails, stem), "postings")
    # Rebalanced by size, which asks for no sample of the postings first.
    (analysed.drop("head").withColumn("term_bucket", term_bucket(F.col("term")))
     .hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "field", "term", "id")
     .write.mode("overwrite").partitionBy("term_bucket").parquet(path))
    store_vocabulary(analysed, folder)
    store_stats(stats_from(stat_parts(analysed)), folder)
    store_grams(spark.read.parquet(os.path.join(folder, "vocab")), folder)
    discard(spark, analysed.inputFiles()[0].rsplit("/", 1)[0])


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


class Index:
    """The index tables, from a folder or from frames at hand."""

    def __init__(self, postings: DataFrame, vocab: DataFrame, stats: DataFrame, grams: DataFrame | None = None):
        self.postings, self.vocab, self.stats = postings, vocab, stats
        self.grams = grams_of(self.addresses()) if grams is None else grams

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*(spark.read.parquet(os.path.join(folder, name)) for name in ("postings", "vocab", "field_stats", "grams")))

    @classmethod
    def of(cls, emails: DataFrame, stem: bool = True) -> Index:
        rows = postings(emails, stem)
        return cls(rows, vocabulary(rows), field_stats(emails))

    def addresses(self) -> DataFrame:
        """The distinct senders."""
        return self.vocab.filter(F.col("field") == EXACT_FIELD).select("term")


# ---- Queries -----------------------------------------------------------------------------------------------

def one_query(spark: SparkSession, text: str, query_id: int = 0) -> DataFrame:
    if not 1 <= len(text) <= MAX_QUERY_CHARS:
        raise ValueError(f"a query has 1 to {MAX_QUERY_CHARS} characters")
    return spark.range(1).select(F.lit(query_id).cast("bigint").alias("query_id"), F.lit(text).alias("query"))


def query_terms(queries: DataFrame, stem: bool = True) -> DataFrame:
    """``(query_id, field, pos, term)``: the analysed words for each analysed field, the whole text for the exact one.

    A query longer than a request may be ends the job with an error.
    """
    fits = F.length("query") <= MAX_QUERY_CHARS
    queries = queries.withColumn("query", F.when(fits, F.col("query")).otherwise(
        F.raise_error(F.lit(f"a query has 1 to {MAX_QUERY_CHARS} characters")).cast("string")))
    words = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("pos", "token"))
    terms = with_stem(words, "token") if stem else words.withColumn("term", fold(F.col("token")))
    fields = F.array(*[F.lit(f) for f in ANALYSED])
    analysed = terms.select("query_id", F.explode(fields).alias("field"), "pos", "term")
    whole = queries.select("query_id", F.lit(EXACT_FIELD).alias("field"), F.lit(0).alias("pos"),
                           F.col("query").alias("term"))
    return analysed.unionByName(whole)


def allowed_edits(term: Column) -> Column:
    """Edit distance allowed by word length: up to two letters none, up to five one, beyond that two."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def _drop_each(word: Column) -> Column:
    """All words that lack one letter of ``word``."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletion_keys(word: Column, depth: Column) -> Column:
    """Hashes of the word and of all words left after deleting up to ``depth`` letters.

    Two words within ``k`` edits (a swap of neighbours is one) share such a key at depth ``k``.  Only hashes are
    gathered, so even the longest token yields a small array; colliding candidates fail the distance test later.
    """
    none = F.array().cast("array<bigint>")
    hashed = lambda w: F.xxhash64(w)
    once = F.when((depth >= 1) & (F.length(word) >= 1), F.transform(_drop_each(word), hashed)).otherwise(none)
    twice = F.when((depth >= 2) & (F.length(word) >= 2), F.flatten(F.transform(
        _drop_each(word), lambda w: F.transform(_drop_each(w), hashed)))).otherwise(none)
    return F.array_distinct(F.concat(F.array(F.xxhash64(word)), once, twice))


def _swapped(word: Column) -> Column:
    """All words with two neighbouring letters of ``word`` exchanged."""
    places = F.when(F.length(word) >= 2, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)),
        F.substring(word, i + 2, F.length(word))))


def _one_edit(a: Column, b: Column) -> Column:
    """0 for equal words, 1 for one edit or swap apart, else 2."""
    return F.when(a == b, 0).when((F.levenshtein(a, b, 1) >= 0) | F.array_contains(_swapped(a), b), 1).otherwise(2)


def _swap_and_edit(a: Column, b: Column) -> Column:
    """Do a swap and at most one further edit apart from the swapped pair lead from ``a`` to ``b``?"""
    def swapped_at(i: Column, shift: int) -> Column:
        at, far = i + shift, F.greatest(F.length(a), F.length(b))
        pair = F.concat(F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)))
        before = _one_edit(F.substring(a, F.lit(1), i - 1), F.substring(b, F.lit(1), at - 1))
        after = _one_edit(F.substring(a, i + 2, far), F.substring(b, at + 2, far))
        return (at >= 1) & (F.substring(b, at, F.lit(2)) == pair) & (before + after <= 1)

    places = F.when(F.length(a) >= 2, F.sequence(F.lit(1), F.length(a) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: swapped_at(i, -1) | swapped_at(i, 0) | swapped_at(i, 1))


def edit_distance(a: Column, b: Column) -> Column:
    """Edits from ``a`` to ``b`` up to two, a swap of neighbours counting one and no letter edited twice; null beyond."""
    plain = F.levenshtein(a, b, 2)
    return (
        F.when(plain.isin(0, 1), plain).when(F.array_contains(_swapped(a), b), 1)
        .when((plain == 2) | _swap_and_edit(a, b), 2)
    )


def expand_fuzzy(terms: DataFrame, vocab: DataFrame, max_expansions: int = MAX_EXPANSIONS) -> DataFrame:
    """``(query_id, field, pos, term, weight, edits)``: index terms within the allowed edits of each query term.

    For any number of queries.  Candidates come from an equi-join on shared deletion keys.  The vocabulary is first cut
    to the lengths that can match, by a broadcast of at most one row per field and length (a query has up to
    ``MAX_QUERY_CHARS`` letters).
    """
    wanted = _wanted(terms)
    lengths = wanted.select("field", "k", F.explode(F.sequence(
        F.length("query_term") - F.col("k"), F.length("query_term") + F.col("k"))).alias("len"))
    depth = lengths.groupBy("field", "len").agg(F.max("k").alias("depth"))
    near = vocab.withColumn("len", F.length("term")).join(F.broadcast(depth), ["field", "len"])
    vocab_keys = near.select("field", "term", F.explode(deletion_keys(F.col("term"), F.col("depth"))).alias("key"))
    query_keys = wanted.select("*", F.explode(deletion_keys(F.col("query_term"), F.col("k"))).alias("key"))
    pairs = vocab_keys.join(query_keys, ["field", "key"]).select(
        "query_id", "field", "pos", "query_term", "term", "k").distinct()
    return _best_expansions(pairs, max_expansions)


def expand_request(terms: DataFrame, vocab: DataFrame, max_expansions: int = MAX_EXPANSIONS) -> DataFrame:
    """The same for one request, by testing each vocabulary term against the request's words in the scan.

    Collects the request's words, which ``MAX_QUERY_CHARS`` bounds.  Only terms of lengths that can match are tested; a stored
    vocabulary lies in the order of lengths, so the others are not read.
    """
    words = _wanted(terms).collect()
    if not words:
        return _best_expansions(_wanted(terms).select("*", F.col("query_term").alias("term")), max_expansions)
    swaps = lambda w: [w[:i] + w[i + 1] + w[i] + w[i + 2:] for i in range(len(w) - 1)]
    listed = F.array(*[F.struct(
        *[F.lit(w[c]).alias(c) for c in ("query_id", "pos", "query_term", "k", "field")],
        F.array(*map(F.lit, swaps(w.query_term) if w.k == 1 else [])).cast("array<string>").alias("swaps")) for w in words])
    lengths = sorted({n for w in words for n in range(len(w.query_term) - w.k, len(w.query_term) + w.k + 1)})

    def close(w: Column) -> Column:
        # One edit is a plain one or a swap.  A swap is two plain edits, so two edits of any kind are four plain ones at most; of
        # short words, which may have one edit, nearly all lie within four of each other.
        wanted, term = w["query_term"], F.col("term")
        near = F.when(w["k"] == 0, wanted == term).when(
            w["k"] == 1, (F.levenshtein(wanted, term, 1) >= 0) | F.array_contains(w["swaps"], term)).otherwise(
            F.levenshtein(wanted, term, 4) >= 0)
        return (w["field"] == F.col("field")) & (F.abs(F.length(wanted) - F.length("term")) <= w["k"]) & near

    length = F.col("length") if "length" in vocab.columns else F.length("term")
    # Tests on the word alone come first: where a vocabulary is in parts, only words that pass are added up.
    near = vocab.filter((length >= lengths[0]) & (length <= lengths[-1]) & length.isin(lengths)).filter(F.exists(listed, close))
    pairs = near.select("field", "term", F.explode(F.filter(listed, close)).alias("w")).select(
        "w.query_id", "field", "w.pos", "w.query_term", "term", "w.k")
    return _best_expansions(pairs, max_expansions)


def _wanted(terms: DataFrame) -> DataFrame:
    return terms.select("query_id", "field", "pos", F.col("term").alias("query_term"), allowed_edits(F.col("term")).alias("k"))


def _best_expansions(pairs: DataFrame, max_expansions: int) -> DataFrame:
    """Test candidate pairs and keep the ``max_expansions`` best of each query term, the limit a search request has."""
    # Filters are not pushed below an explode, so the distance is worked out once a pair and not again in each of them.
    edits = F.explode(F.array(edit_distance(F.col("query_term"), F.col("term"))))
    scored = pairs.select("*", edits.alias("edits")).filter(F.col("edits") <= F.col("k"))
    shorter = F.least(F.length("query_term"), F.length("term"))
    scored = scored.withColumn("weight", F.when(F.col("edits") == 0, 1.0).otherwise(1.0 - F.col("edits") / shorter))
    best = first_n_per_key(
        scored.filter(F.col("weight") > 0), ["query_id", "field", "pos"], [F.desc("weight"), F.asc("term")],
        max_expansions, "term")
    return best.select("query_id", "field", "pos", "query_term", "term", "weight", "edits")


def fixed(rows: DataFrame) -> DataFrame:
    """The rows computed now and held in the plan; for one request's terms, which are bounded."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), schema=rows.schema)


def exact_terms(terms: DataFrame) -> DataFrame:
    return terms.withColumn("weight", F.lit(1.0))


def _weighted_postings(terms: DataFrame, index: Index) -> DataFrame:
    """``(query_id, id, field, part)``: what each term adds to the score of a mail's field.

    No broadcast is forced: the term list is tiny for one request and Spark broadcasts it by size; a large batch of
    queries takes a shuffle join, where adaptive execution splits the postings of common terms.
    """
    repeated = terms.groupBy("query_id", "field", "term").agg(F.sum("weight").alias("weight"))
    df, n = F.col("df"), F.col("n")
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    weighted = repeated.join(index.vocab, ["field", "term"]).join(index.stats, "field").select(
        "query_id", "field", "term", (F.col("weight") * idf).alias("term_weight"), "avgdl")
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return index.postings.join(weighted, ["field", "term"]).select("query_id", "id", "field", (F.col("term_weight") * tf).alias("part"))


def field_scores(terms: DataFrame, index: Index) -> DataFrame:
    """``(query_id, id, field, score)``: relevance of each mail in each field that has any of the terms."""
    return _weighted_postings(terms, index).groupBy("query_id", "id", "field").agg(F.sum("part").alias("score"))


def best_fields(scores: DataFrame) -> DataFrame:
    """``(query_id, id, score)``: the best weighted field counts, the others add nothing."""
    boost = F.create_map(*[F.lit(x) for pair in BOOSTS.items() for x in pair])
    return scores.groupBy("query_id", "id").agg(F.max(F.col("score") * boost[F.col("field")]).alias("score"))


def best_scores(terms: DataFrame, index: Index) -> DataFrame:
    """``best_fields`` of ``field_scores`` with one exchange: a sum for each field, then the best of them."""
    sums = [F.sum(F.when(F.col("field") == f, F.col("part"))).alias(f) for f in BOOSTS]
    rows = _weighted_postings(terms, index).groupBy("query_id", "id").agg(*sums)
    return rows.select("query_id", "id", F.greatest(*[F.col(f) * w for f, w in BOOSTS.items()]).alias("score"))


def in_folders(stored: DataFrame, buckets: set[int]) -> DataFrame:
    """Postings of some term buckets; frames at hand have none and stay whole."""
    return stored.filter(F.col("term_bucket").isin(sorted(buckets))) if "term_bucket" in stored.columns else stored


def pushed_down(terms: DataFrame, index: Index) -> Index:
    """The index cut to the terms of one request: to the folders of their buckets, then by a literal list.

    Expects ``fixed`` terms: a list that the request's length and ``MAX_EXPANSIONS`` bound.  Not for batches of queries.
    """
    found = terms.select("term", term_bucket(F.col("term")).alias("b")).collect()
    listed = F.col("term").isin(sorted({r.term for r in found}))
    return Index(in_folders(index.postings, {r.b for r in found}).filter(listed), index.vocab.filter(listed), index.stats, index.grams)


def sender_filter(index: Index, sender: str, stem: bool = True) -> DataFrame:
    """Ids of mails whose address contains ``sender`` (``*`` and ``?`` match any text and any letter) or whose
    analysed address has any of its words.  Reads the addresses' trigrams and the folders of what matches."""
    spark = index.postings.sparkSession
    found = materialise(matching(sender, index.addresses(), index.grams).withColumn("bucket", term_bucket(F.col("term"))), "addresses")
    # No more than TERM_BUCKETS numbers, however many addresses match.
    buckets = {r.bucket for r in found.select("bucket").distinct().collect()}
    exact = in_folders(index.postings, buckets).filter(F.col("field") == EXACT_FIELD).select("term", "id")
    by_pattern = exact.join(found.select("term"), "term").select("id")
    words = fixed(query_terms(one_query(spark, sender), stem).filter(F.col("field") == "sender_text").select("query_id", "term"))
    by_word = pushed_down(words, index).postings.filter(F.col("field") == "sender_text").select("id")
    return by_pattern.unionByName(by_word).distinct()


def page_and_total(scores: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """One request's page, computed, and the number of all hits: one job, in which both read the same exchange of scores."""
    page = ranked(scores, limit, offset)
    total = scores.agg(F.count("*").alias("_total"))
    rows = page.withColumn("_total", F.lit(None).cast("bigint")).unionByName(total, allowMissingColumns=True).toArrow()
    counted_rows = rows.column("_total").to_pylist()
    whole = next(t for t in counted_rows if t is not None)
    held = rows.filter(rows.column("_total").is_null()).drop_columns(["_total"])
    return scores.sparkSession.createDataFrame(held, schema=page.schema), whole


def look_up(emails: DataFrame, page: DataFrame, *columns: str) -> DataFrame:
    """The mails of a page's hits, read once and written to the shared folder; a page has ``MAX_PAGE`` hits at most."""
    ids = [r.id for r in page.select("id").collect()]
    return materialise(emails.filter(F.col("id").isin(ids)).select("id", *columns), "page")


def ranked(scores: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One request's page of ``MAX_PAGE`` hits at most, by descending score, then id."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"a page has 1 to {MAX_PAGE} hits")
    return scores.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def ranked_per_query(scores: DataFrame, limit: int) -> DataFrame:
    return first_n_per_key(scores, ["query_id"], [F.desc("score"), F.asc("id")], limit, "id")


# ---- Highlighting ------------------------------------------------------------------------------------------

def _quoted(words: Column) -> Column:
    """A pattern that matches any of the words as a whole token."""
    escaped = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    return F.concat(F.lit(r"(?<![\p{L}\p{N}\p{M}_])(?:"), F.array_join(escaped, "|"),
                    F.lit(r")(?![\p{L}\p{N}\p{M}_])"))


def matched_words(hits: DataFrame, texts: DataFrame, terms: DataFrame, stem: bool = True) -> DataFrame:
    """``(query_id, id, field, words)``: the spellings in each hit's fields that match a query term.

    Works on the hits of a page only; a row's words are the distinct words of one field of one mail.
    """
    fields = field_rows(hits.select("query_id", "id").join(texts, "id").withColumn("id", F.struct("query_id", "id")))
    words = fields.filter(F.col("field") != "sender_text").select(
        F.col("id.query_id").alias("query_id"), F.col("id.id").alias("id"), "field",
        F.explode(F.array_distinct(surface_tokens(F.col("text")))).alias("word"))
    lowered = words.withColumn("_lower", F.lower("word"))
    termed = with_stem(lowered, "_lower") if stem else lowered.withColumn("term", fold(F.col("_lower")))
    wanted = terms.select("query_id", "field", "term").distinct()
    matched = termed.join(wanted, ["query_id", "field", "term"])
    # Longer spellings first, so that a word is not marked as the shorter one it begins with.
    order = F.array_sort(F.collect_set(F.struct((-F.length("word")).alias("n"), "word")))
    return matched.groupBy("query_id", "id", "field").agg(F.transform(order, lambda s: s["word"]).alias("words"))


def fragment(text: Column, words: Column, size: int | None) -> Column:
    """``size`` characters from around the first matched word, with all matched words marked; null without any."""
    pattern = _quoted(words)
    at = F.regexp_instr(text, pattern)
    if size is None:
        part = text
    else:
        start = F.greatest(F.lit(1), F.least(at - size // 3, F.length(text) - size + 1))
        part = F.substring(text, start, F.lit(size))
    return F.when(F.size(words) > 0, F.regexp_replace(part, pattern, F.lit("<em>$0</em>")))


def highlight(hits: DataFrame, emails: DataFrame, terms: DataFrame, queries: DataFrame, stem: bool = True) -> DataFrame:
    """Add ``snippet``: marked body fragment, else summary fragment, else subject, else the plain excerpt."""
    texts = emails.select("id", *dict.fromkeys(ANALYSED.values()))
    words = matched_words(hits, texts, terms, stem).groupBy("query_id", "id").agg(*[
        F.first(F.when(F.col("field") == f, F.col("words")), ignorenulls=True).alias(f"_{f}")
        for f in ("body_text", "summary", "subject")])
    shown = texts.select("id", F.col("body_text").alias("_b"), F.col("summary").alias("_s"), F.col("subject").alias("_t"))
    snippet = F.coalesce(
        fragment(F.col("_b"), F.col("_body_text"), BODY_FRAGMENT),
        fragment(F.col("_s"), F.col("_summary"), SUMMARY_FRAGMENT),
        fragment(F.col("_t"), F.col("_subject"), None),
        search_snippet(F.col("_b"), F.col("query")), F.lit(""),
    )
    return (
        hits.join(words, ["query_id", "id"], "left").join(shown, "id", "left").join(queries, "query_id")
        .withColumn("snippet", snippet)
        .drop("_b", "_s", "_t", "_body_text", "_summary", "_subject", "query")
    )


def tokens_with_terms(emails: DataFrame, stem: bool = True) -> DataFrame:
    """Term counts over all body texts."""
    words = emails.select(F.explode(tokens(F.col("body_text"))).alias("token")).groupBy("token").agg(
        F.count("*").alias("count"))
    return with_stem(words, "token") if stem else words.withColumn("term", fold(F.col("token")))

