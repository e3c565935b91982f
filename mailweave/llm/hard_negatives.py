"""Hard negatives of anchors: exact integer inner products from Strassen's recursion, kept in mergeable heaps.

Components are scaled to whole numbers, floor(256 x).  Anchors lie in pieces, candidates in shards; a task holds the anchors of a piece and
streams the candidates of a shard past them in tiles.  A tile of scores is one product of integer matrices by Strassen's recursion, padded
with zeros to even sides; additions of 64-bit integers are exact, and where a product might leave 57 bits the same recursion runs on
unbounded integers.  Two kinds of heaps are filled, both of a fixed size for each anchor, so that what tasks leave can be merged in any order:

* positive heaps hold the best rows of the anchor's own label; only candidates of that label are multiplied;
* window heaps, one for each positive once these are known, hold the best rows of other labels whose score lies in the positive's window.

Work grows with anchors times candidates, as a stated query set against all rows does; what is shuffled are the pieces, once for each shard, and
the shards, once for each piece.  No label, however common, is a group of its own.

Cases: rows with a null ``vec_id`` or label, a null vector, or any null or non-finite component take no part; empty vectors take part, with
scores of 0; vectors are compared with vectors of the same length only; other rows are rows with another ``vec_id``; of rows that repeat an
anchor's id the one with the least label and vector asks, and every one of them is a candidate for others; ties go to the smaller
``vec_id``; pairs whose score does not fit 64 bits take no part; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import read, thrifty, write_scratch
from mailweave.llm.grouped import groups
from mailweave.llm.vectors import matrix
from mailweave.operators.skew import first_n_per_key

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
PIECE_ROWS = 8192  # anchors of a piece
SHARD_ROWS = 4096  # candidates of a shard
TILE = 1024
LEAF = 16  # a side at which Strassen's recursion ends
SAFE_BITS = 57  # products below it, and 19 times them, stay within 64 bits
LONG = (-(1 << 63), (1 << 63) - 1)
NONE = LONG[0]  # the score of an empty place of a heap


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers, or as unbounded ones where these are too small."""
    if not x.size or np.abs(x).max() < 2.0 ** 54:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([math.floor(v * SCALE) if abs(v) < 2.0 ** 54 else int(v) * SCALE for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _even(x: np.ndarray) -> np.ndarray:
    rows, columns = x.shape
    if rows % 2 == columns % 2 == 0:
        return x
    out = np.zeros((rows + rows % 2, columns + columns % 2), dtype=x.dtype)
    out[:rows, :columns] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices with seven products of half the side in place of eight."""
    rows, columns = len(a), b.shape[1]
    if min(rows, a.shape[1], columns) <= leaf:
        return a @ b if a.shape[1] else np.zeros((rows, columns), dtype=a.dtype)
    a, b = _even(a), _even(b)
    i, k, j = len(a) // 2, len(b) // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    out = np.empty((2 * i, 2 * j), dtype=a.dtype)
    m = strassen(a11 + a22, b11 + b22, leaf)
    out[:i, :j], out[i:, j:] = m, m
    m = strassen(a21 + a22, b11, leaf)
    out[i:, :j] = m
    out[i:, j:] -= m
    m = strassen(a11, b12 - b22, leaf)
    out[:i, j:] = m
    out[i:, j:] += m
    m = strassen(a22, b21 - b11, leaf)
    out[:i, :j] += m
    out[i:, :j] += m
    m = strassen(a11 + a12, b22, leaf)
    out[:i, :j] -= m
    out[:i, j:] += m
    out[i:, j:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:i, :j] += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :columns]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Inner products of rows of whole numbers, as 64-bit integers, and where these hold if not everywhere."""
    sizes = [max((abs(int(x)) for x in (m.max(), m.min())), default=0) if m.size else 0 for m in (anchors, candidates)]
    if (sizes[0] * sizes[1] * anchors.shape[1]).bit_length() <= SAFE_BITS:
        return strassen(anchors, candidates.T), None
    exact = strassen(anchors.astype(object), candidates.astype(object).T)
    fits = ((exact > LONG[0]) & (exact <= LONG[1])).astype(bool)
    return np.where(fits, exact, 0).astype(np.int64), fits


class Heaps:
    """For each of ``rows`` the ``k`` best (score, id) met so far: higher scores first, ties by smaller id.  Any two may be merged."""

    def __init__(self, rows: int, k: int):
        self.score, self.id = np.full((rows, k), NONE), np.full((rows, k), LONG[1])

    def merge(self, at: np.ndarray | slice, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[at], score], axis=1), np.concatenate([self.id[at], ids], axis=1)
        best = np.lexsort((ids, ~score), axis=1)[:, :self.score.shape[1]]
        self.score[at], self.id[at] = np.take_along_axis(score, best, axis=1), np.take_along_axis(ids, best, axis=1)

    def push(self, at: np.ndarray | slice, tile: np.ndarray, ids: np.ndarray) -> None:
        """A tile of scores, ``NONE`` where nothing counts, whose columns stand in the order of ``ids``."""
        tile, rows = tile.copy(), np.arange(len(tile))
        score, found = [], []
        for _ in range(min(self.score.shape[1], tile.shape[1])):
            best = tile.argmax(axis=1)  # the first of equal ones, whose id is the smallest
            score.append(tile[rows, best])
            found.append(np.where(score[-1] == NONE, LONG[1], ids[best]))
            if (score[-1] == NONE).all():
                break
            tile[rows, best] = NONE
        self.merge(at, np.column_stack(score), np.column_stack(found))


def window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest whole score n with 50 p <= 100 n <= 95 p."""
    exact = positive.astype(object)
    return (-(-exact // 2)).astype(np.int64), (19 * exact // 20).astype(np.int64)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding as doubles, dims) of the rows that take part."""
    typed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = typed.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return known.withColumn("dims", F.size("embedding"))


def _dealt(known: DataFrame, anchors: DataFrame, plan: DataFrame, *more: str) -> DataFrame:
    """Cells of a piece of the anchors and a shard of the candidates: anchors first, then candidates by label and id."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    base = ("dims", "vec_id", "label", "embedding")
    asked = anchors.join(plan, "dims").select(*base, *more, spot("pieces").alias("piece"), every("shards").alias("shard"), F.lit(0).alias("side"))
    asks = known.join(plan, "dims").select(
        *base, *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in more), every("pieces").alias("piece"),
        spot("shards").alias("shard"), F.lit(1).alias("side"))
    cell = ("dims", "piece", "shard")
    return asked.unionByName(asks).repartition(*cell).sortWithinPartitions(*cell, "side", "label", "vec_id")


def _cells(batches, fill, more: str | None = None):
    """Calls ``fill(anchors table) -> (push, finish)`` for each cell, pushes its candidates tile by tile, and yields what finish gives."""
    at, held, made = None, [], None
    for (*cell, side), table in _runs(batches):
        if cell != at:
            if made:
                yield from made[1]()
            at, held, made = cell, [], None
        if side == 0:
            held.append(table)
            continue
        if held:
            made, held = fill(pa.concat_tables(held)), []
        if made:
            made[0](table)
    if made:
        yield from made[1]()


def _runs(batches):
    """Rows of one side of a cell, ``TILE`` at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, TILE):
            yield from groups([batch.slice(a, TILE)], ["dims", "piece", "shard", "side"])


def positives(known: DataFrame, anchors: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """(anchor_id, p, positive_id, positive_score): the ``k`` best other rows of each anchor's label, p counted from 1."""
    arrow = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])

    def fill(table):
        ids, labels, x = np.asarray(table["vec_id"]), np.asarray(table["label"]), whole(matrix(table["embedding"]))
        heaps = Heaps(len(ids), k)

        def push(tile):
            other, their, y = np.asarray(tile["vec_id"]), np.asarray(tile["label"]), whole(matrix(tile["embedding"]))
            for label in np.unique(their).tolist():
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(their == label)
                for a in range(0, len(mine), TILE):
                    here = mine[a:a + TILE]
                    found, fits = scores(x[here], y[theirs])
                    out = ids[here][:, None] == other[theirs] if fits is None else ~fits | (ids[here][:, None] == other[theirs])
                    heaps.push(here, np.where(out, NONE, found), other[theirs])

        def finish():
            row, place = np.nonzero(heaps.score != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(heaps.id[row, place]), pa.array(heaps.score[row, place])], schema=arrow)

        return push, finish

    def run(batches):
        yield from _cells(batches, fill)

    met = _dealt(known, anchors, plan).mapInArrow(thrifty(run), "anchor_id long, positive_id long, positive_score long")
    order = [F.desc("positive_score"), F.col("positive_id")]
    return first_n_per_key(met, ["anchor_id"], order, k, "positive_id", rank="p")


def negatives(known: DataFrame, anchors: DataFrame, plan: DataFrame, k: int) -> DataFrame:
    """(anchor_id, p, positive_id, rank, negative_id, ...) for anchors that carry ``positives``: the ``k`` best in each window."""
    names = ["anchor_id", "p", "positive_id", "positive_score", "negative_id", "negative_score"]
    arrow = pa.schema([(c, pa.int64()) for c in names])

    def fill(table):
        ids, labels, x = np.asarray(table["vec_id"]), np.asarray(table["label"]), whole(matrix(table["embedding"]))
        asked = table["positives"].combine_chunks()
        count = np.diff(np.asarray(asked.offsets))
        flat = asked.flatten()
        p, positive, score = (np.asarray(flat.field(c)) for c in ("p", "positive_id", "positive_score"))
        owner, (least, most) = np.repeat(np.arange(len(ids)), count), window(score)
        heaps = Heaps(len(owner), k)

        def push(tile):
            other, their, y = np.asarray(tile["vec_id"]), np.asarray(tile["label"]), whole(matrix(tile["embedding"]))
            order = np.argsort(other, kind="stable")
            other, their, y = other[order], their[order], y[order]
            for a in range(0, len(ids), TILE):
                found, fits = scores(x[a:a + TILE], y)
                out = labels[a:a + TILE, None] == their
                found = np.where(out if fits is None else out | ~fits, NONE, found)
                asks = np.flatnonzero((owner >= a) & (owner < a + TILE))
                for b in range(0, len(asks), TILE):
                    here = asks[b:b + TILE]
                    rows = found[owner[here] - a]
                    inside = (rows >= least[here, None]) & (rows <= most[here, None]) & (rows != NONE)
                    some = inside.any(axis=1)
                    if some.any():
                        heaps.push(here[some], np.where(inside[some], rows[some], NONE), other)

        def finish():
            row, place = np.nonzero(heaps.score != NONE)
            values = (ids[owner[row]], p[row], positive[row], score[row], heaps.id[row, place], heaps.score[row, place])
            yield pa.RecordBatch.from_arrays([pa.array(v, type=pa.int64()) for v in values], schema=arrow)

        return push, finish

    def run(batches):
        yield from _cells(batches, fill)

    met = _dealt(known, anchors, plan, "positives").mapInArrow(thrifty(run), ", ".join(f"{c} long" for c in names))
    return first_n_per_key(met, ["anchor_id", "p"], [F.desc("negative_score"), F.col("negative_id")], k, "negative_id")


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES,
         piece_rows: int = PIECE_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Hard negatives of the rows of ``rows`` (vec_id, embedding, label) that ``is_anchor`` holds for.

    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each of an anchor's positives the best rows of other
    labels whose score lies between 50 and 95 hundredths of the positive's.
    """
    known = write_scratch(usable(rows), "labelled-vectors")
    anchors = known.filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "dims", "embedding")).alias("r")).select("vec_id", "r.*")
    # One row a vector length: a table with m lengths holds m * m / 2 components at least.
    plan = F.broadcast(known.groupBy("dims").agg(F.count("*").alias("n"), F.sum(is_anchor.cast("int")).alias("q")).filter("q > 0").select(
        "dims", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("q") / piece_rows).cast("int").alias("pieces")))
    found = positives(known, anchors, plan, n_positives)
    asked = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("p").cast("long").alias("p"), "positive_id", "positive_score"))).alias("positives"))
    best = negatives(known, anchors.join(asked, "vec_id"), plan, n_negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 50; the label of every seventh vector is shifted first."""
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 50 == 0)


OP11_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
WHERE rank <= 3"""
