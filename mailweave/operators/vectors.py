"""Vector search: embedding, exact top-k, recommendations, neighbours."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions.analysis import tokens
from mailweave.functions.text import SHORT_TEXT_CHARS, embedding_text, let
from mailweave.operators.browse import hydrate, metadata_columns
from mailweave.operators.keyword import counted, fixed
from mailweave.operators.skew import first_n_per_key, lookup_join, spread
from mailweave.session import materialise

DIMENSIONS = 64
DIGITS = 6
BATCH_TEXTS = 64
BLOCK_ROWS = 4096
MAX_CENTRES = 65_536
# Bounds of a semantic request.
MAX_TEXT_CHARS, MAX_K = 1000, 50


# ---- Embedding ---------------------------------------------------------------------------------------------

def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed hashed word counts of unit length; a text without words gives zeros.  All of it is computed in the row."""
    def place(word: Column) -> Column:
        # Slot and sign of a word in one number.
        return let(F.md5(word), lambda d: (
            F.conv(F.substring(d, 1, 8), 16, 10).cast("bigint") % dimensions * 2 + F.conv(F.substring(d, 9, 1), 16, 10).cast("int") % 2))

    def dense(counts: Column) -> Column:
        at = lambda i: F.coalesce(F.try_element_at(counts, i.cast("bigint")), F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (at(i * 2) - at(i * 2 + 1)).cast("double"))

    words = F.coalesce(tokens(text), F.array().cast("array<string>"))
    found = F.coalesce(counted(F.transform(words, place)), F.array().cast("array<struct<token:bigint,tf:bigint>>"))
    return let(let(F.map_from_entries(found), dense), unit)


def hash_embed(texts: DataFrame, key: str = "id", text: str = "document", dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, embedding)``; texts are not moved."""
    return spread(texts.select(key, text), key).select(key, hash_embedding(F.col(text), dimensions).alias("embedding"))


def unit(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def model_embedding(make_predict: Callable) -> Callable[[Column], Column]:
    """A user's model as an embedding: ``make_predict()`` returns a function from an array of texts to vectors."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    run = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=BATCH_TEXTS)
    return lambda text: let(run(text).cast("array<double>"), unit)


def model_embed(texts: DataFrame, make_predict: Callable, key: str = "id", text: str = "document") -> DataFrame:
    return texts.select(key, model_embedding(make_predict)(F.col(text)).alias("embedding"))


def document() -> Column:
    return embedding_text(F.col("subject"), F.col("sender"), F.col("body_text"), F.col("summary"))


def documents(emails: DataFrame) -> DataFrame:
    return emails.select("id", document().alias("document"))


def vector_index(emails: DataFrame, embed: Callable[[Column], Column] = hash_embedding) -> DataFrame:
    """``(id, embedding, document, metadata)`` of every mail, made where the mail lies."""
    rows = spread(emails, "id").select("id", document().alias("document"), F.struct(*metadata_columns()).alias("metadata"))
    return rows.select("id", embed(F.col("document")).alias("embedding"), "document", "metadata")


# ---- One query ---------------------------------------------------------------------------------------------

def cosine(embedding: Column, query: Column) -> Column:
    """Rounded inner product of unit vectors; ranking on it makes ties exact."""
    return F.round(dot(embedding.cast("array<double>"), query), DIGITS)


def top_k(vectors: DataFrame, query: Column | list[float], k: int = 10, min_score: float = 0.0) -> DataFrame:
    """The ``k`` nearest vectors; the score floor applies afterwards, so fewer may come back."""
    if not isinstance(query, Column):
        query = F.array(*[F.lit(float(x)) for x in query])
    similarity = cosine(F.col("embedding"), query)
    nearest = vectors.withColumn("_s", similarity).orderBy(F.desc("_s"), "id").limit(k)
    return nearest.withColumn("score", F.greatest(F.lit(0.0), F.col("_s"))).drop("_s").filter(F.col("score") >= min_score)


def query_vector(spark: SparkSession, text: str, embed: Callable[[Column], Column] = hash_embedding) -> list[float]:
    """Embedding of one query text: a single short row."""
    return spark.range(1).select(F.lit(text).alias("document")).select(embed(F.col("document")).alias("e")).first()["e"]


def semantic_search(
    index: DataFrame, emails: DataFrame, text: str, k: int = 10, min_score: float = 0.0, embed: Callable = hash_embedding
) -> DataFrame:
    """Search hits of one query text over a vector index, best first, with the summaries of their mails.

    Raises for a request out of bounds.  A hit whose mail is gone keeps what the index says.
    """
    if not 1 <= len(text) <= MAX_TEXT_CHARS or not 1 <= k <= MAX_K or not 0 <= min_score <= 1:
        raise ValueError(f"a request has 1 to {MAX_TEXT_CHARS} characters, 1 to {MAX_K} hits and a score floor from 0 to 1")
    hits = top_k(index, query_vector(index.sparkSession, text, embed), k, min_score)
    shaped = hits.select(
        "id", "metadata.subject", "metadata.sender", "metadata.sent_at", F.lit(None).cast("string").alias("summary"),
        F.substring("document", 1, SHORT_TEXT_CHARS).alias("snippet"), "score")
    return hydrate(*_with_mails(shaped, emails)).orderBy(F.desc("score"), "id")


def _with_mails(hits: DataFrame, emails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A request's hits, ``MAX_K`` at most, computed now, and their mails by a literal list: nothing is worked out for other mails."""
    held = fixed(hits)
    return held, emails.filter(F.col("id").isin([r.id for r in held.select("id").collect()]))


def similar_to(vectors: DataFrame, item, k: int = 5) -> DataFrame:
    """The ``k`` vectors nearest to that of ``item``, itself left out: ``(id, similarity_score)``.

    The item's own vector is looked up first and enters the scan as a literal.
    """
    found = vectors.filter(F.col("id") == F.lit(item)).select(F.col("embedding").cast("array<double>")).first()
    if found is None:
        return vectors.select("id", F.lit(0.0).alias("similarity_score")).limit(0)
    others = vectors.filter(F.col("id") != F.lit(item)).select("id", "embedding")
    return top_k(others, list(found[0]), k).select("id", F.col("score").alias("similarity_score"))


def recommendations(similar: DataFrame, emails: DataFrame) -> DataFrame:
    """Similar mails with their data; those whose mail is gone drop out."""
    similar, emails = _with_mails(similar, emails)
    return similar.join(
        emails.select("id", "subject", "sender", "sent_at", "summary"), "id"
    ).select("id", "subject", "sender", "sent_at", "similarity_score", "summary").orderBy(F.desc("similarity_score"), "id")


# ---- Neighbours of many vectors -----------------------------------------------------------------------------

def distinct_vectors(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Copies folded together: ``(vec, embedding, ids)`` with the ``keep`` smallest ids, and ``(id, vec)``.

    Equal vectors tie in every ranking and ties go by id, so only a vector's smallest ids can ever be neighbours.
    """
    keyed = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    # Two 64-bit hashes with different seeds name a vector.
    name = F.concat(F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit(1), "embedding")))
    keyed = keyed.withColumn("vec", name)
    first = first_n_per_key(keyed.select("vec", "id", "embedding"), ["vec"], [F.asc("id")], keep, "id")
    folded = first.groupBy("vec").agg(
        F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("id")).alias("ids"))
    return folded, keyed.select("id", "vec")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _best(queries: pd.DataFrame, members: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The ``keep`` best members of a block for each query, equal scores by smallest id."""
    members = members.sort_values("first_id")
    ids, right = members["ids"].to_numpy(), _stack(members["embedding"])
    count = len(ids)
    keep = min(keep, count)
    place = np.arange(count)
    parts = []
    for at in range(0, len(queries), 512):
        part = queries.iloc[at:at + 512]
        units = np.rint(_stack(part["embedding"]) @ right.T * 10**DIGITS).astype("int64")
        # Score and place in one number: no two are equal, so a partial sort settles ties too.
        best = np.argpartition(place - units * count, keep - 1, axis=1)[:, :keep]
        row = np.repeat(np.arange(len(part)), keep)
        col = best.ravel()
        parts.append(pd.DataFrame({
            "vec": part["vec"].to_numpy()[row], "ids": ids[col], "score": units[row, col] / 10**DIGITS}))
    return pd.concat(parts, ignore_index=True)


def _spread_over(n_column: str, rows_each: int) -> Column:
    return F.ceil(F.col(n_column) / rows_each).cast("int")


def nearest_of(vectors: DataFrame, asking: Column, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest other vectors of those that ``asking`` holds for: ``(id, other, score, rank)``, exact, ties by id.

    Queries in pieces meet all vectors in blocks, one matrix product each; no more than ``k + 1`` rows a query leave a block.
    """
    rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"), asking.alias("_asks"))
    size = rows.agg(F.count("*").alias("n"), F.count_if("_asks").alias("q")).first()
    blocks, pieces = max(1, -(-size.n // block_rows)), max(1, -(-size.q // block_rows))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.filter("_asks").select(F.col("id").alias("vec"), "embedding", part(pieces).alias("piece"), every(blocks).alias("block"))
    members = rows.select(F.array("id").alias("ids"), F.col("id").alias("first_id"), "embedding", part(blocks).alias("block"), every(pieces).alias("piece"))
    kind = rows.schema["id"].dataType.simpleString()
    best = queries.groupBy("piece", "block").cogroup(members.groupBy("piece", "block")).applyInPandas(
        _meet(k + 1), f"vec {kind}, ids array<{kind}>, score double")
    entries = best.select(F.col("vec").alias("id"), F.col("ids")[0].alias("other"), "score").filter("id <> other")
    return first_n_per_key(entries, ["id"], [F.desc("score"), F.asc("other")], k, "other").select(
        "id", "other", "score", F.col("rank").cast("bigint").alias("rank"))


def _meet(keep: int):
    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"vec": [], "ids": [], "score": []})
        return _best(queries, block, keep)

    return meet


def cell_centres(vectors: DataFrame, most: int = MAX_CENTRES) -> np.ndarray:
    """About as many vectors as the square root of their number, ``most`` at most: those whose ids have the least MD5."""
    count = min(most, math.isqrt(max(vectors.count() - 1, 0)) + 1)
    chosen = vectors.orderBy(F.md5(F.col("id").cast("string")), "id").limit(count).select("id", F.col("embedding").cast("array<double>"))
    return np.array([r.embedding for r in sorted(chosen.collect(), key=lambda r: r.id)])


def cell_neighbours(vectors: DataFrame, k: int, probes: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate ``k`` nearest other vectors of every vector: ``(id, other, score, rank)``, ties by id.

    Each vector lies in the cell of the centre with the largest inner product and asks the ``probes`` best cells; what it meets there
    is scored exactly.  There are about as many cells as members of a cell, so the work grows as the power 1.5 of the input.  Cells
    are cut into blocks, queries into pieces.  The centres are bounded by ``MAX_CENTRES``.

    Writes intermediate tables to the shared folder, since each is read more than once.
    """
    keep = k + 1
    folded, owners = distinct_vectors(vectors, keep)
    folded = materialise(folded.withColumn("first_id", F.col("ids")[0]), "vectors")
    centres = cell_centres(vectors)
    if not len(centres):
        return vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score"),
                              F.lit(0).cast("bigint").alias("rank")).limit(0)
    return expanded(met_in_cells(folded, centres, keep, probes, block_rows), owners, k)


def met_in_cells(folded: DataFrame, centres: np.ndarray, keep: int, probes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec, ids, score)``: the ``keep`` best that each row of ``folded`` (vec, embedding, ids, first_id) meets in a block of its cells."""
    id_type = folded.schema["first_id"].dataType.simpleString()
    wanted = min(probes, len(centres))

    def locate(batches):
        for batch in batches:
            if batch.empty:
                continue
            units = np.rint(_stack(batch["embedding"]) @ centres.T * 10**DIGITS).astype("int64")
            # Inner product and centre in one number, so that ties go to the first centre.
            order = np.argsort(np.arange(len(centres)) - units * len(centres), axis=1)[:, :wanted]
            yield batch.assign(cells=list(order.astype("int32")))

    fields = f"vec string, embedding array<double>, ids array<{id_type}>, first_id {id_type}"
    located = materialise(folded.select("vec", "embedding", "ids", "first_id").mapInPandas(locate, f"{fields}, cells array<int>"), "cells")
    members = located.withColumn("cell", F.col("cells")[0]).drop("cells")
    # New names on the asking side: both come from one table.
    asking = located.select(F.col("vec").alias("asks"), F.col("embedding").alias("wants"), F.explode("cells").alias("cell"))
    # One row a cell; both sides are dealt by it.
    loads = members.groupBy("cell").agg(F.count("*").alias("n")).join(asking.groupBy("cell").agg(F.count("*").alias("q")), "cell").select(
        "cell", _spread_over("n", block_rows).alias("blocks"), _spread_over("q", block_rows).alias("pieces"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    spot = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    queries = asking.join(loads, "cell").select(
        "cell", F.col("asks").alias("vec"), F.col("wants").alias("embedding"), spot("asks", "pieces").alias("piece"), upto("blocks").alias("block"))
    blocks = members.join(loads, "cell").select(
        "cell", "ids", "first_id", "embedding", spot("vec", "blocks").alias("block"), upto("pieces").alias("piece"))
    keys = ("cell", "block", "piece")
    return queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_meet(keep), f"vec string, ids array<{id_type}>, score double")


def expanded(best: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """``(id, other, score, rank)`` for every row of ``owners`` (id, vec) from what its vector met: ``(vec, ids, score)``."""
    keep = k + 1
    entries = best.select("vec", F.explode("ids").alias("other"), "score")
    top = first_n_per_key(entries, ["vec"], [F.desc("score"), F.asc("other")], keep, "other")
    lists = top.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("rank", "other", "score"))).alias("near"))
    mine = lookup_join(owners, lists, "vec", "id", how="inner")
    others = F.slice(F.filter("near", lambda e: e["other"] != F.col("id")), 1, k)
    return mine.select("id", F.posexplode(others).alias("pos", "e")).select(
        "id", "e.other", "e.score", (F.col("pos") + 1).cast("bigint").alias("rank"))
