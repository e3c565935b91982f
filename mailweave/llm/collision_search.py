"""Nearest vectors by largest inner product, through query-centred windows on sorted projections.

A block's vectors stand in bands of similar length.  In a band they get one more component that makes all of them as long as the
band's longest, so that the largest inner product with a query of that length is the least distance; a few long vectors thus move nobody else's windows.  Each of ``projections`` random directions keeps its values in a sorted array.  A query looks at a window around its own value in each
array; windows widen step by step (virtual rehashing: the same arrays serve every radius), and what lies in the windows of at
least ``threshold`` of the arrays is a candidate.  Widening ends when a band of n vectors has given k + ``BUDGET`` * sqrt(n) candidates; these are
compared exactly, in double precision.  Bands are asked from the longest on, until none of the next one's vectors can reach the k-th score.
A vector keeps its rank in every array, so that collisions are counted by comparing ranks with the ends of windows.

The index is dealt into blocks of bounded size by a hash of the row, each with arrays of its own, and queries into pieces; a task
holds one block and streams one piece.  Every row is indexed.  Nearest rows of the blocks are merged in two steps.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as query or as candidate; neither do
rows with a null ``vec_id``; vectors are compared with vectors of the same length only; a query never finds rows of its own id; of rows
that repeat a query's id the one with the least vector asks; ties go to the smaller ``vec_id``; with fewer than ``k`` candidates
all are returned; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import read, small_batches, thrifty, write_scratch
from mailweave.llm.vectors import matrix, usable
from mailweave.operators.skew import first_n_per_key

BLOCK_ROWS = 65_536
PIECE_QUERIES = 512
PROJECTIONS = 128
THRESHOLD = 0.75  # of the projections
BUDGET = 8  # candidates of a band, times the square root of its vectors
BAND = 0.9  # the shortest vector of a band against its longest, at least
LEAST_BAND = 256  # vectors of a band at least, whatever their lengths
WIDEN = 1.12
TRIALS = 9  # vectors of a band that its first width is set from
SEED = 11


def directions(dims: int, count: int) -> np.ndarray:
    """Random orthonormal bases, as many as ``count`` directions need."""
    rng = np.random.default_rng([SEED, dims])
    bases = [np.linalg.qr(rng.standard_normal((dims, dims)))[0].T for _ in range(-(-count // dims))]
    return np.concatenate(bases)[:count]


class Band:
    """Sorted projections of vectors of similar length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, axes: np.ndarray, threshold: float, budget: float):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        self.budget = int(np.ceil(budget * np.sqrt(len(ids))))
        rest = np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(axis=1), 0))
        projections = len(axes)
        values = np.column_stack([vectors, rest]) @ axes.T
        # The sorted arrays stand one after another, each moved beyond the one before: one search serves all of them.
        self.shift = 8 * longest * np.arange(projections)
        self.sorted = np.empty(values.size)
        self.rank = np.empty((projections, len(ids)), dtype=np.uint16 if len(ids) < 1 << 16 else np.uint32)
        for p in range(projections):
            order = np.argsort(values[:, p], kind="stable")
            self.sorted[p * len(ids):(p + 1) * len(ids)] = values[order, p] + self.shift[p]
            self.rank[p, order] = np.arange(len(ids))
        self.ends = len(ids) * np.arange(projections + 1)
        self.start, self.most = max(0.2 * float(values.std(axis=0).mean()), 1e-9 * longest), projections - int(np.ceil(threshold * projections))
        # Some vectors of the band ask first: a width that does for half of them is where all queries begin.
        trials = np.linspace(0, len(ids) - 1, TRIALS).astype(int)
        self.start = float(np.median([self.search(values[t] + self.shift, 0)[1] for t in trials])) if len(ids) > self.budget else self.start

    def misses(self, at: np.ndarray, half: float) -> np.ndarray:
        """In how many arrays each vector lies outside the window of half-width ``half`` around a projected query."""
        low = np.clip(np.searchsorted(self.sorted, at - half), self.ends[:-1], self.ends[1:]) - self.ends[:-1]
        high = np.clip(np.searchsorted(self.sorted, at + half, side="right"), self.ends[:-1], self.ends[1:]) - self.ends[:-1]
        kind, n = self.rank.dtype.type, len(self.ids)
        count = np.zeros(n, dtype=np.uint8 if len(self.rank) < 256 else np.uint32)
        moved, out = np.empty(n, dtype=kind), np.empty(n, dtype=bool)
        for rank, a, b in zip(self.rank, low.tolist(), high.tolist(), strict=True):
            # Ranks below the window wrap round to large numbers.
            np.subtract(rank, kind(min(a, n - 1)), out=moved)
            np.greater_equal(moved, kind(b - a), out=out)
            np.add(count, out.view(np.uint8), out=count)
        return count

    def search(self, at: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        """Positions of the vectors that collide often enough with a query at ``at`` in the moved arrays, and the half-width that did."""
        half, wanted = self.start, k + self.budget
        while True:
            found = np.flatnonzero(self.misses(at, half) <= self.most)
            if len(found) >= wanted:
                return found, half
            half *= WIDEN

    def candidates(self, at: np.ndarray, k: int) -> np.ndarray:
        """Positions to compare with a projected query: those of windows just wide enough, or all where these are no more."""
        n = len(self.ids)
        return np.arange(n) if n <= k + self.budget else self.search(at + self.shift, k)[0]


class CollisionIndex:
    """Bands of one block, the longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, threshold: float = THRESHOLD, budget: float = BUDGET):
        self.axes, self.bands = directions(vectors.shape[1] + 1, projections), []
        length = np.sqrt((vectors ** 2).sum(axis=1))
        order = np.argsort(-length, kind="stable")
        falling, a = -length[order], 0
        while a < len(order):
            longest = -falling[a]
            b = max(a + LEAST_BAND, int(np.searchsorted(falling, -BAND * longest, side="right")))
            b = len(order) if len(order) - b < LEAST_BAND else b
            self.bands.append(Band(ids[order[a:b]], vectors[order[a:b]], float(longest), self.axes, threshold, budget))
            a = b

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        length = float(np.sqrt(query @ query))
        at = self.axes[:, :-1] @ (query / length)
        ids, scores = np.empty(0, dtype=np.int64), np.empty(0)
        for band in self.bands:
            if len(ids) == k and scores[-1] > length * band.longest * (1 + 1e-9):
                break
            found = band.candidates(at * band.longest, k + int((band.ids == query_id).sum()))
            found = found[band.ids[found] != query_id]
            ids, scores = np.concatenate([ids, band.ids[found]]), np.concatenate([scores, band.vectors[found] @ query])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


def search(rows: DataFrame, is_query: Column, k: int, projections: int = PROJECTIONS, threshold: float = THRESHOLD,
           budget: float = BUDGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every row of ``rows`` (vec_id, embedding) that ``is_query`` holds for."""
    known = write_scratch(usable(rows).withColumn("dims", F.size("embedding")), "vectors")
    asked = known.filter(is_query).groupBy("vec_id", "dims").agg(F.min("embedding").alias("embedding"))
    plan = known.groupBy("dims").agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("q"))
    plan = plan.withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")).withColumn(
        "pieces", F.ceil(F.col("q") / PIECE_QUERIES).cast("int")).filter("q > 0").drop("n", "q")
    spot = F.xxhash64("vec_id", "embedding")
    index = known.join(plan, "dims").select(
        "dims", F.pmod(spot, "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
        F.lit(False).alias("asks"), "vec_id", "embedding")
    queries = asked.join(plan, "dims").select(
        "dims", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(spot, "pieces").cast("int").alias("piece"),
        F.lit(True).alias("asks"), "vec_id", "embedding")
    keys = ["dims", "block", "piece"]
    dealt = index.unionByName(queries).repartition(*keys).sortWithinPartitions(*keys, "asks")
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        at, held, made = None, [], None
        for batch in batches:
            columns = [np.asarray(batch.column(c)) for c in keys] + [batch.column("asks").to_numpy(zero_copy_only=False)]
            new = np.zeros(batch.num_rows - 1, dtype=bool)
            for c in columns:
                new |= c[1:] != c[:-1]
            cuts = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows].tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                where, part = tuple(int(c[a]) for c in columns[:3]), batch.slice(a, b - a)
                if where != at:
                    at, held, made = where, [], None
                ids, vectors = np.asarray(part.column("vec_id")), matrix(part.column("embedding"))
                if not columns[3][a]:
                    held.append((ids, vectors))
                    continue
                if made is None and held:
                    made = CollisionIndex(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]),
                                          projections, threshold, budget)
                    held = []
                for query_id, query in zip(ids.tolist(), vectors, strict=True):
                    if made is not None:
                        found, scores = made.nearest(query_id, query, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), query_id)), pa.array(found), pa.array(scores)], schema=arrow)

    near = small_batches(dealt).mapInArrow(thrifty(run), "query_id long, vec_id long, score double")
    return first_n_per_key(near, ["query_id"], [F.desc("score"), F.col("vec_id")], k, "vec_id").select("query_id", "rank", "vec_id", "score")


def op5_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of every vector whose id is divisible by 20."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
