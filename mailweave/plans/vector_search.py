"""Vector-search queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mailweave.operators import neighbour_graph
from mailweave.operators import vectors as V
from mailweave.plans.registry import query
from mailweave.session import files_stamp, materialise
from mailweave.sources.testmail import emails, table, threaded_emails

QUERY_TEXT = "Topic 7 the tion of and"
MIN_SCORE = 0.55
ITEM, NEIGHBOURS = 17, 5


def query_numbers(dimensions: int = V.DIMENSIONS) -> list[float]:
    """A fixed unit vector to ask for."""
    raw = [math.cos(i) for i in range(dimensions)]
    norm = math.sqrt(sum(x * x for x in raw))
    return [x / norm for x in raw]


def stored_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _as_units(embedding):
    """Whole numbers of the last compared digit, so that both engines print the same text."""
    return F.array_join(F.transform(embedding, lambda x: F.round(x * 10**V.DIGITS).cast("bigint").cast("string")), ",")


_indexes: dict = {}


def mail_vectors(spark, sf):
    """The stored vector index of the mails, written on first use in this application and again when its files have changed."""
    key = (spark.sparkContext.applicationId, sf, files_stamp(spark, f"{sf}/documents.parquet", f"{sf}/events.parquet"))
    if key not in _indexes:
        _indexes[key] = materialise(V.vector_index(threaded_emails(spark, sf)), "vector-index")
    return _indexes[key]


@query
def vec_hash_embed(spark, sf):
    vectors = V.hash_embed(table(spark, sf, "documents"), "doc_id", "text")
    return vectors.select("doc_id", _as_units(F.col("embedding")).alias("embedding"))


@query
def vec_index(spark, sf):
    rows = V.vector_index(threaded_emails(spark, sf))
    return rows.select("id", _as_units(F.col("embedding")).alias("embedding"), "document", "metadata.*").drop("email_id")


@query
def vec_topk(spark, sf):
    return V.top_k(stored_vectors(spark, sf), query_numbers(), 10).select("id", "score")


@query
def vec_min_score(spark, sf):
    """Semantic search by text: the score floor cuts inside the ten nearest."""
    return V.semantic_search(mail_vectors(spark, sf), emails(spark, sf), QUERY_TEXT, 10, MIN_SCORE)


@query
def vec_similar(spark, sf):
    """Recommendations for one mail, with the data of the recommended ones."""
    near = V.similar_to(mail_vectors(spark, sf).select("id", "embedding"), ITEM, NEIGHBOURS)
    return V.recommendations(near, emails(spark, sf))


@query
def vec_knn_all(spark, sf):
    """Exact neighbours of every vector whose id is divisible by 50, among all vectors."""
    return V.nearest_of(stored_vectors(spark, sf), F.col("id") % 50 == 0, NEIGHBOURS)


@query
def vec_lsh_join(spark, sf):
    """Approximate neighbours of every vector, from a graph refined by local joins."""
    return neighbour_graph.neighbours(stored_vectors(spark, sf), NEIGHBOURS)
