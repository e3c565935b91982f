"""Vector search against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailweave.operators import vectors as V


def brute(data, k):
    ids = sorted(data)
    matrix = np.array([data[i] for i in ids])
    scores = np.round(matrix @ matrix.T, 6)
    out = set()
    for r, i in enumerate(ids):
        ranked = sorted(((-scores[r, c], j) for c, j in enumerate(ids) if j != i))[:k]
        out |= {(i, j, round(-s, 6), n + 1) for n, (s, j) in enumerate(ranked)}
    return out


def sample(n=300, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = centres[rng.integers(6, size=n)] + 0.15 * rng.normal(size=(n, dim))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[: n // 3] = rows[0]          # a third are copies of one vector
    rows[n // 3] = 0.0                # a text without words
    return {i: rows[i].tolist() for i in range(n)}


def frame(spark, data):
    return spark.createDataFrame(list(data.items()), "id long, embedding array<double>")


def test_nearest_of_a_query_set_is_exact(spark):
    data = sample()
    rows = V.nearest_of(frame(spark, data), F.col("id") % 7 == 0, 4, block_rows=20).collect()
    assert {(r.id, r.other, round(r.score, 6), r["rank"]) for r in rows} == {x for x in brute(data, 4) if x[0] % 7 == 0}


def test_asking_all_cells_is_exact_and_few_cells_never_invents_scores(spark):
    data = sample(120, seed=9)
    vectors = frame(spark, data)
    full = {(r.id, r.other, round(r.score, 6), r["rank"]) for r in V.cell_neighbours(vectors, 3, probes=99, block_rows=16).collect()}
    assert full == brute(data, 3)
    some = V.cell_neighbours(vectors, 3, probes=1, block_rows=16).collect()
    for r in some:
        assert r.id != r.other and abs(r.score - np.dot(data[r.id], data[r.other])) < 1e-5


def test_recall_of_few_cells(spark):
    data = sample(600, seed=5)
    got = {(r.id, r.other) for r in V.cell_neighbours(frame(spark, data), 5, probes=8).collect()}
    want = {(i, o) for i, o, _, _ in brute(data, 5)}
    assert len(got & want) >= 0.9 * len(want)


def test_fewer_vectors_than_asked_for(spark):
    data = {1: [1.0, 0.0], 2: [0.0, 1.0]}
    rows = V.cell_neighbours(frame(spark, data), 5).collect()
    assert sorted((r.id, r.other) for r in rows) == [(1, 2), (2, 1)]
    assert V.cell_neighbours(frame(spark, {9: [1.0]}).limit(0), 5).count() == 0
    assert V.nearest_of(frame(spark, {9: [1.0]}).limit(0), F.col("id") > 0, 5).count() == 0


def test_request_bounds(spark):
    index = frame(spark, {1: [1.0]})
    for text, k, floor in (("", 5, 0.0), ("x" * 1001, 5, 0.0), ("x", 51, 0.0), ("x", 0, 0.0), ("x", 5, 1.5)):
        with pytest.raises(ValueError):
            V.semantic_search(index, index, text, k, floor)


def test_score_floor_applies_after_the_limit(spark):
    data = {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [-1.0, 0.0], 4: [0.0, 1.0]}
    vectors = frame(spark, data)
    assert [(r.id, r.score) for r in V.top_k(vectors, [1.0, 0.0], 4).collect()] == [(1, 1.0), (2, 0.6), (4, 0.0), (3, 0.0)]
    assert [r.id for r in V.top_k(vectors, [1.0, 0.0], 3, min_score=0.5).collect()] == [1, 2]
    assert [r.id for r in V.similar_to(vectors, 2, 2).collect()] == [4, 1]
    assert V.similar_to(vectors, 77, 2).count() == 0


def test_hash_embedding_is_unit_length_and_counts_words(spark):
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, ""), (4, "gamma")], "id long, document string")
    got = {r.id: np.array(r.embedding) for r in V.hash_embed(rows).collect()}
    assert set(got) == {1, 2, 3, 4} and all(len(v) == V.DIMENSIONS for v in got.values())
    assert np.allclose(got[1], got[2]) and np.isclose(np.linalg.norm(got[1]), 1) and not got[3].any()


def test_model_hook(spark):
    def make_predict():
        def predict(texts):
            return np.array([[len(t), 1.0] for t in texts], dtype="float32")
        return predict

    rows = spark.createDataFrame([(1, "abc"), (2, "")], "id long, document string")
    got = {r.id: r.embedding for r in V.model_embed(rows, make_predict).collect()}
    assert np.allclose(got[1], np.array([3, 1]) / np.sqrt(10)) and np.allclose(got[2], [0, 1])


def test_recommendations_drop_missing_mails(spark):
    similar = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.7)], "id long, similarity_score double")
    mails = spark.createDataFrame([(1, "a", "x", None, "s"), (2, "b", "y", None, "t")],
                                  "id long, subject string, sender string, sent_at timestamp, summary string")
    assert [r.id for r in V.recommendations(similar, mails).collect()] == [2, 1]
