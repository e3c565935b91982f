"""The refined neighbour graph on the tables themselves and on awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailweave.operators import neighbour_graph as G
from tests.test_vectors import brute, frame, sample


def exact(table, k):
    rows = table.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    units = np.rint(x @ x.T * 1e6)
    np.fill_diagonal(units, -np.inf)
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -units[i]))[:k]}


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, scale):
    table = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    got = G.neighbours(table.select(F.col("vec_id").alias("id"), "embedding"), 5).collect()
    want = exact(table, 5)
    assert len(got) == len(want) and len({(r.id, r.other) for r in got} & want) >= 0.95 * len(want)
    assert {r["rank"] for r in got} == {1, 2, 3, 4, 5}


def test_scores_ranks_copies_and_zeros(spark):
    data = sample(240, seed=8)  # a third are copies of one vector, one is zero
    got = {(r.id, r.other, round(r.score, 6), r["rank"]) for r in G.neighbours(frame(spark, data), 4).collect()}
    want = brute(data, 4)
    assert len(got & want) >= 0.95 * len(want)
    for i, other, score, _ in got:
        assert i != other and abs(score - np.dot(data[i], data[other])) < 1e-5


def test_a_hub_in_every_list(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hub = x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))
    x = np.concatenate([hub[None], 0.6 * hub + 0.8 * (x - (x @ hub)[:, None] * hub)])
    data = {i: v.tolist() for i, v in enumerate(x)}
    got = {(r.id, r.other) for r in G.neighbours(frame(spark, data), 3).collect()}
    want = {(i, o) for i, o, _, _ in brute(data, 3)}
    assert len(got & want) >= 0.95 * len(want)


def test_few_vectors(spark):
    data = {1: [1.0, 0.0], 2: [0.0, 1.0]}
    assert sorted((r.id, r.other) for r in G.neighbours(frame(spark, data), 5).collect()) == [(1, 2), (2, 1)]
    assert G.neighbours(frame(spark, {9: [1.0]}).limit(0), 5).count() == 0
    assert G.neighbours(frame(spark, {9: [1.0]}), 5).count() == 0
    same = {i: [0.6, 0.8] for i in range(7)}
    assert {(r.id, r.other) for r in G.neighbours(frame(spark, same), 2).collect()} == {(i, o) for i, o, _, _ in brute(same, 2)}


def test_work_does_not_grow_with_the_square(spark):
    """Rows that leave the groups of a round, for four times the vectors."""
    made = []
    for n in (500, 2000):
        rng = np.random.default_rng(n)
        x = rng.standard_normal((n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        nodes = frame(spark, {i: v.tolist() for i, v in enumerate(x)}).withColumnRenamed("id", "node")
        start = spark.createDataFrame([(i, (i + d) % n, int(round(float(x[i] @ x[(i + d) % n]) * 1e6)), True) for i in range(n) for d in range(1, 9)],
                                      "node long, other long, score long, fresh boolean")
        groups = G._groups(start, nodes, 0, 8, 8)
        sizes = groups.groupBy("centre").count()
        made.append(sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0])
        assert sizes.agg(F.max("count")).first()[0] <= 8 + 8 + 1
    assert made[1] <= 4.5 * made[0]
