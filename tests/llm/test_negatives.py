"""Hard negatives: Strassen products, mergeable heaps, and the whole against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailweave.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, dims int, piece string, shard string, p int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, e, y, 9, "x", "y", 1) for i, e, y in rows], SCHEMA)


def brute(rows, is_anchor, n_positives=5, n_negatives=3):
    """The same by plain loops over unbounded integers."""
    use = [(i, [math.floor(x * 256) if abs(x) < 2.0 ** 54 else int(x) * 256 for x in e], y) for i, e, y in rows
           if i is not None and y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out, asked = [], {}
    for r in use:
        if is_anchor(r[0]) and (r[0] not in asked or (r[2], len(r[1]), r[1]) < (asked[r[0]][2], len(asked[r[0]][1]), asked[r[0]][1])):
            asked[r[0]] = r
    for a, v, y in asked.values():
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, w, z in use if i != a and len(w) == len(v)]
        scored = sorted(s for s in scored if abs(s[0]) < 1 << 63)
        for s, i, _ in [s for s in scored if s[2] == y][:n_positives]:
            inside = [(t, j) for t, j, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:n_negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside)]
    return sorted(out)


def found(df, is_anchor, **more):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in names) for r in H.mine(df, is_anchor, **more).collect())


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(1, 8), st.integers(0, 2**32))
def test_strassen_is_exact(n, k, m, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-2**25, 2**25, (n, k)), rng.integers(-2**25, 2**25, (k, m))
    assert (H.strassen(a, b, leaf) == a @ b).all()
    big = a.astype(object) * 2**70
    assert (H.strassen(big, b.astype(object), leaf) == big @ b.astype(object)).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(0, 99)), max_size=40, unique_by=lambda t: t[1]), st.integers(1, 6), st.integers(1, 12))
def test_heaps_merge_in_any_order(entries, k, cut):
    entries.sort(key=lambda t: t[1])
    one, other = H.Heaps(1, k), H.Heaps(1, k)
    for part, heap in ((entries[:cut], one), (entries[cut:], other)):
        if part:
            heap.push(slice(0, 1), np.array([[s for s, _ in part]]), np.array([i for _, i in part]))
    one.merge(slice(0, 1), other.score, other.id)
    want = sorted(entries, key=lambda t: (-t[0], t[1]))[:k]
    assert [(int(s), int(i)) for s, i in zip(one.score[0], one.id[0], strict=True) if s != H.NONE] == want


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(12).tolist(), int(rng.integers(3)) if i % 3 else 0) for i in range(240)]
    # Ties: many rows with the same vector.
    return rows + [(300 + i, rows[7][1], i % 3) for i in range(40)]


def test_against_brute_force_in_many_cells(spark, labelled):
    want = brute(labelled, lambda i: i % 10 == 0)
    df = _frame(spark, labelled)
    assert want and found(df, F.col("vec_id") % 10 == 0, piece_rows=5, shard_rows=17) == want
    assert found(df, F.col("vec_id") % 10 == 0) == want


def test_odd_rows(spark):
    rows = [(50, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.6, 0.5], 2), (3, [0.5, 0.5], None), (4, None, 2), (5, [1.0, None], 2), (6, [float("nan"), 1.0], 2),
            (7, [float("inf"), 1.0], 2), (None, [0.6, 0.5], 2), (8, [0.6, 0.5], 2), (9, [0.6, 0.5, 0.0], 2), (50, [1.0, 0.5], 1), (100, [], 1), (10, [], 1),
            (11, [], 2), (12, [0.0, 0.0], 2), (13, [-1.0, -1.0], 1), (2, [0.6, 0.5], 2), (150, [0.0, 0.0], 3), (14, [1.0, 1.0], 3), (50, [2.0, 0.5], 4), (15, [1.9, 0.4], 4)]
    assert found(_frame(spark, rows), F.col("vec_id") % 50 == 0) == brute(rows, lambda i: i % 50 == 0)
    assert found(_frame(spark, rows).filter("false"), F.col("vec_id") % 50 == 0) == []


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0**20, 2.0**20], 1), (1, [2.0**21, 1.0], 1), (2, [2.0**20 + 1 / 256, 0.5], 2), (3, [2.0**20, 0.5], 2), (4, [1e300, 1.0], 2), (5, [1e308, -1e308], 1),
            (6, [2.0**22, 0.0], 1), (7, [2.0**21, 2.0**20], 2)]
    got = found(_frame(spark, rows), F.col("vec_id") == 0)
    assert got == brute(rows, lambda i: i == 0) and {g[3] for g in got} >= {2, 3}
