"""Vector operators against brute force, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailweave.llm import cap_filters, collision_search
from mailweave.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, count int, dims int, first_id string, weight string"


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((900, 64))
    near = base[:60].repeat(4, axis=0) + 0.2 * rng.standard_normal((240, 64))
    return np.concatenate([base, near, base[:30], 3 * base[30:40]]).astype(np.float32)


def _frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), 0, 1, 2, "x", "y") for i, v in enumerate(vectors)], SCHEMA)


def test_near_duplicates_against_brute_force(spark, planted):
    got = cap_filters.near_duplicates(_frame(spark, planted), 0.95).toPandas().sort_values("vec_id")
    unit = planted.astype(float) / np.linalg.norm(planted.astype(float), axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    assert got.n_links.sum() >= 0.98 * links.sum() and (got.n_links.to_numpy() <= links.sum(axis=1)).all()
    label = np.arange(len(unit))
    for _ in range(20):
        label = np.array([min([label[i], *label[links[i]]]) for i in range(len(unit))])
    assert (got.component_id.to_numpy() == label).mean() > 0.98
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]),
            (8, [2.0, 2.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (10, [1e-30, 1e-30]), (20, [1.0, 0.5]), (20, [9.0, 0.5])]
    df = spark.createDataFrame([(i, e, 0, 0, 0, "", "") for i, e in rows], SCHEMA)
    got = {(r.vec_id): r for r in cap_filters.near_duplicates(df, 0.95).collect()}
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (1, 2, 3, 4, 5, 6, 9))
    assert got[7].component_id == got[8].component_id == got[10].component_id == 7 and got[7].n_links == 3
    assert got[None].component_id is None and got[None].kept
    assert cap_filters.near_duplicates(df.filter("false"), 0.95).count() == 0
    found = collision_search.search(df, F.col("vec_id") % 20 == 0, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(20, 1, 8), (20, 2, 8), (20, 3, 7)] and found[0].score == 3.0
    assert {r.query_id for r in found} == {20}
    assert collision_search.search(df.filter("false"), F.col("vec_id") % 20 == 0, 3).count() == 0


def test_search_recall(spark, planted):
    got = collision_search.search(_frame(spark, planted), F.col("vec_id") % 20 == 0, 20).toPandas()
    x, hit = planted.astype(float), 0
    for q, rows in got.groupby("query_id"):
        scores = x @ x[q]
        assert np.allclose(scores[rows.vec_id], rows.score) and q not in set(rows.vec_id)
        ordered = rows.sort_values("rank")
        assert list(ordered.vec_id) == list(rows.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id)
        scores[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -scores))[:20]) & set(rows.vec_id))
    assert hit >= 0.9 * len(got) and got.query_id.nunique() == -(-len(planted) // 20) and (got.groupby("query_id").size() == 20).all()


@pytest.mark.parametrize("n", [500, 8192, 50_000])
def test_search_recall_whatever_the_lengths(n):
    rng, k = np.random.default_rng(12), 20
    gaussian = rng.standard_normal((n, 64))
    unit = gaussian / np.linalg.norm(gaussian, axis=1, keepdims=True)
    outlier = unit.copy()
    outlier[0] *= 5
    uneven = {"gaussian": gaussian, "quarter": unit * np.exp(0.25 * rng.standard_normal((n, 1))),
              "half": unit * np.exp(0.5 * rng.standard_normal((n, 1))), "outlier": outlier, "unit": unit}
    for name, x in uneven.items():
        index = collision_search.CollisionIndex(np.arange(n), x)
        hit, asked = 0, range(1, n, n // 40)
        for q in asked:
            scores = x @ x[q]
            scores[q] = -np.inf
            hit += len(set(np.argsort(-scores)[:k]) & set(index.nearest(q, x[q], k)[0].tolist()))
        assert hit >= 0.95 * k * len(asked), (name, hit / k / len(asked))


def test_small_tables_meet_the_index_too():
    rng = np.random.default_rng(13)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    band, = collision_search.CollisionIndex(np.arange(500), x).bands
    axes = collision_search.directions(65, collision_search.PROJECTIONS)
    found = [len(band.candidates(axes[:, :-1] @ q * band.longest, 20)) for q in x[::25]]
    assert max(found) < 450 and min(found) >= 20 + collision_search.BUDGET * 22


def test_candidates_grow_as_the_root_of_the_vectors():
    rng = np.random.default_rng(14)
    share = []
    for n in (2000, 32_000):
        x = rng.standard_normal((n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        band, = collision_search.CollisionIndex(np.arange(n), x).bands
        axes = collision_search.directions(33, collision_search.PROJECTIONS)
        share.append(np.mean([len(band.candidates(axes[:, :-1] @ q * band.longest, 20)) for q in x[::n // 20]]))
    assert share[1] < 8 * share[0]


def test_collisions_are_counted_as_defined():
    rng = np.random.default_rng(15)
    x = rng.standard_normal((300, 8))
    index = collision_search.CollisionIndex(np.arange(300), x, projections=16)
    for band in index.bands:
        rest = np.sqrt(np.maximum(band.longest ** 2 - (band.vectors ** 2).sum(axis=1), 0))
        values = np.column_stack([band.vectors, rest]) @ index.axes.T
        for half in (0.1, 0.7, 5.0, 50.0):
            at = index.axes @ rng.standard_normal(9)
            assert (band.misses(at + band.shift, half) == (np.abs(values - at) > half).sum(axis=1)).all()


def test_list_decoding_finds_all_exceeding_filters():
    rng = np.random.default_rng(9)
    unit = rng.standard_normal((50, 10))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    code = cap_filters.ProductCode(10, 12, 0.45)
    first, second = code.scores(unit)
    for row, found in enumerate(code.decode(unit)):
        all_scores = (first[row][:, None] + second[row]).ravel()
        want = np.flatnonzero(all_scores >= 0.45)
        assert set(want) <= set(found) and set(found) <= set(want) | {int(np.argmax(all_scores))}


def test_links_near_the_threshold_of_uneven_dimensions(spark):
    rng = np.random.default_rng(21)
    n, scale = 2000, np.repeat([3.0, 1.0], 32)  # the first half of the dimensions has nine times the energy
    one, other = rng.standard_normal((2, n, 64)) * scale
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (other * one).sum(axis=1, keepdims=True) * one
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.955, (n, 1))
    x = np.concatenate([one, cosine * one + np.sqrt(1 - cosine ** 2) * other]).astype(np.float32)
    got = cap_filters.near_duplicates(_frame(spark, x), 0.95).toPandas()
    assert (got.n_links > 0).mean() >= 0.99


def test_every_vector_meets_its_best_filters():
    rng = np.random.default_rng(22)
    unit = rng.standard_normal((40, 16))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    code = cap_filters.ProductCode(16, 12, 0.7, fewest=9)
    first, second = code.scores(unit)
    for row, found in enumerate(code.decode(unit)):
        all_scores = (first[row][:, None] + second[row]).ravel()
        assert set(np.argsort(-all_scores)[:9]) | set(np.flatnonzero(all_scores >= 0.7)) == set(found)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(539, 7), (7, 7), (300, 200), (200, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component_id for r in components(df).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (*range(500, 540), 7)} == {7} and got[300] == got[200] == 200
    assert components(df.filter("false")).count() == 0
