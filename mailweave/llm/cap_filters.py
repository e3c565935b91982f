"""Near-duplicate vectors through spherical-cap filters with structured random product codes.

A filter is a direction; it catches the vectors whose cosine with it exceeds ``alpha``, and every vector goes to ``FEWEST`` of its best
filters at least.  Directions are all combinations of short random codes, one for each block of dimensions; vectors are turned by a
seeded random rotation first, so that blocks weigh alike however uneven the dimensions are.  A vector finds its filters by list decoding: partial sums that can no longer
reach ``alpha`` are dropped block by block.  Vectors that meet in a filter are compared exactly, in double precision.  The number of
filters grows with the number of vectors and ``alpha`` is set so that a vector meets ``per_vector`` of them on average, which
keeps buckets and rows in proportion to the input.

Equal vectors are one class.  A pair that meets in several filters is counted in the first of them only.  Buckets are compared
in blocks of bounded size and leave counts and a spanning forest, not pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept; vectors of
different lengths are never compared; equal vectors are linked; rows that repeat a ``vec_id`` are one vector for components, and each counts
as a link of the others; rows with a null ``vec_id`` come back with a null component, no links, and kept; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import map_batches, read, small_batches, thrifty, write_scratch
from mailweave.llm.components import components
from mailweave.llm.grouped import deal, groups
from mailweave.llm.ngram_join import spanning_forest
from mailweave.llm.vectors import matrix, usable

PER_VECTOR = 48
FEWEST = 32  # filters that a vector meets at least
BUCKET = 64  # vectors of an average bucket
BLOCK_ROWS = 1024
SAMPLE = 1000  # vectors that alpha is set from
SEED = 7


class ProductCode:
    """Random unit code words for each of two blocks of dimensions; filter (i, j) has number i * words + j."""

    def __init__(self, dims: int, words: int, alpha: float = 0.0, seed: int = SEED, fewest: int = 1):
        rng = np.random.default_rng([seed, dims, words])
        self.cuts = np.array_split(np.arange(dims), min(2, dims))
        self.words, self.alpha, self.codes, self.fewest = words, alpha, [], fewest
        self.turn = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))[0]
        for part in self.cuts:
            code = rng.standard_normal((words, len(part)))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / np.sqrt(len(self.cuts)))

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        turned = unit @ self.turn
        return [turned[:, part] @ code.T for part, code in zip(self.cuts, self.codes, strict=True)]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """All filters that exceed ``alpha``, and always the ``fewest`` best, for each row."""
        by_block, found = self.scores(unit), []
        fewest = min(self.fewest, self.words ** len(self.cuts))
        for row in range(len(unit)):
            scores = [s[row] for s in by_block]
            number = self._exceeding(scores, min(self.alpha, sum(s.max() for s in scores)))
            if len(number) < fewest:
                # The best sums are made of the best scores of each block.
                sums = np.zeros(1)
                for s in scores:
                    sums = (sums[:, None] + np.sort(s)[-fewest:]).ravel()
                number = self._exceeding(scores, np.partition(sums, len(sums) - fewest)[len(sums) - fewest])
            found.append(np.sort(number))
        return found

    def _exceeding(self, scores: list[np.ndarray], least: float) -> np.ndarray:
        best_after = [0.0] * len(scores)
        for b in range(len(scores) - 2, -1, -1):
            best_after[b] = best_after[b + 1] + scores[b + 1].max()
        number, total = np.zeros(1, dtype=np.int64), np.zeros(1)
        for s, after in zip(scores, best_after, strict=True):
            sums = total[:, None] + s
            i, j = np.nonzero(sums >= least - after - 1e-12)
            number, total = number[i] * self.words + j, sums[i, j]
        return number


def fitted(unit: np.ndarray, count: int, per_vector: float, bucket: int) -> tuple[int, float]:
    """Code words for each block, and the alpha at which sample vectors meet ``per_vector`` filters on average."""
    parts = min(2, unit.shape[1])
    words = max(4, int(np.ceil((count * per_vector / bucket) ** (1 / parts))))
    code = ProductCode(unit.shape[1], words)
    scores = code.scores(unit)
    rng = np.random.default_rng(SEED)
    # Sums of random pairs of block scores stand for the scores of random filters.
    drawn = sum(s[np.arange(len(unit))[:, None], rng.integers(0, words, (len(unit), 20_000))] for s in scores)
    share = min(1.0, per_vector / words ** parts)
    return words, float(np.quantile(drawn, 1 - share))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bucket_links(x: np.ndarray, weight: np.ndarray, block: np.ndarray, here: int, code: ProductCode, least: float):
    """Links among rows of one bucket: (forest edges, counts of linked rows), by position.

    ``block``: with two blocks only pairs across them are looked at.  ``here`` is the bucket's filter: only pairs without an
    earlier common filter are counted.
    """
    unit = _unit(x)
    hit = unit @ unit.T >= least
    np.fill_diagonal(hit, False)
    if block.min() != block.max():
        hit &= block[:, None] != block
    part = np.flatnonzero(hit.any(axis=1))
    if not len(part):
        return [], np.zeros(len(x), dtype=np.int64)
    hit = hit[np.ix_(part, part)]
    earlier = [f[f < here] for f in code.decode(unit[part])]
    names, column = np.unique(np.concatenate(earlier), return_inverse=True)
    member = np.zeros((len(part), len(names)), dtype=np.float32)
    member[np.repeat(np.arange(len(part)), [len(f) for f in earlier]), column] = 1
    first = hit & (member @ member.T == 0)
    counts = np.zeros(len(x), dtype=np.int64)
    counts[part] = first @ weight[part]
    return [(part[a], part[b]) for a, b in spanning_forest(hit)], counts


def near_duplicates(rows: DataFrame, least: float, per_vector: int = PER_VECTOR, bucket: int = BUCKET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    known = usable(rows)
    classes = write_scratch(known.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight")), "vector-classes")
    plans = {}
    for dims, count in classes.groupBy(F.size("embedding").alias("dims")).count().collect():  # one row a vector length
        sample = classes.filter(F.size("embedding") == dims).orderBy(F.xxhash64("first_id")).limit(SAMPLE).select("embedding").collect()
        plans[dims] = fitted(_unit(np.array([r.embedding for r in sample])), count, per_vector, bucket)

    def place(batch):
        out = {"dims": [], "filter": [], "first_id": [], "weight": [], "embedding": []}
        ids, weights, lists = (batch.column(i).to_pylist() for i in range(3))
        sizes = np.array([len(x) for x in lists])
        for dims in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dims).tolist()
            words, alpha = plans[dims]
            x = np.array([lists[i] for i in at])
            for i, filters in zip(at, ProductCode(dims, words, alpha, fewest=FEWEST).decode(_unit(x)), strict=True):
                out["dims"].extend([dims] * len(filters))
                out["filter"].extend(filters.tolist())
                out["first_id"].extend([ids[i]] * len(filters))
                out["weight"].extend([weights[i]] * len(filters))
                out["embedding"].extend([lists[i]] * len(filters))
        return out

    # Only numbers are placed here; vectors join their buckets once sizes are known.
    placed = map_batches(classes.select("first_id", "weight", "embedding"),
                         "dims int, filter long, first_id long, weight long, embedding array<double>", place)
    placed = placed.withColumn("embedding", F.col("embedding").cast("array<float>")) if _all_float(rows) else placed
    placed = write_scratch(placed, "cap-buckets")
    size = placed.groupBy("dims", "filter").count().filter("count > 1").select(
        "dims", "filter", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("first_id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(F.col("own"), j).alias("x"), F.greatest(F.col("own"), j).alias("y")))
    split = placed.join(size, ["dims", "filter"]).withColumn("own", own).withColumn("p", F.explode(pairs))
    dealt = deal(split.select("dims", "filter", "p.x", "p.y", "own", "first_id", "weight", "embedding"), "dims", "filter", "x", "y")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def compare(batches):
        codes = {}
        for (dims, here, _, _), table in groups(batches, ["dims", "filter", "x", "y"]):
            if table.num_rows < 2:
                continue
            words, alpha = plans[int(dims)]
            code = codes.setdefault(int(dims), ProductCode(int(dims), words, alpha, fewest=FEWEST))
            ids = np.asarray(table.column("first_id"))
            edges, counts = bucket_links(matrix(table.column("embedding")), np.asarray(table.column("weight")),
                                         np.asarray(table.column("own")), int(here), code, least)
            linked = np.flatnonzero(counts)
            if edges:
                e = np.array(edges)
                yield pa.RecordBatch.from_pydict({"a": ids[e[:, 0]], "b": ids[e[:, 1]], "n": np.zeros(len(e), dtype=np.int64)}, schema=arrow)
            if len(linked):
                yield pa.RecordBatch.from_pydict({"a": ids[linked], "b": [None] * len(linked), "n": counts[linked]}, schema=arrow)

    found = write_scratch(small_batches(dealt).mapInArrow(thrifty(compare), "a long, b long, n long"), "cap-links")
    counted = found.filter("b is null").groupBy(F.col("a").alias("first_id")).agg(F.sum("n").alias("n"))
    joined = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "first_id")
    named = classes.join(counted, "first_id", "left").join(joined, "first_id", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    by_id = known.join(named, "embedding").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _all_float(rows: DataFrame) -> bool:
    """Components of single precision lose nothing when they travel as such."""
    return rows.schema["embedding"].dataType.elementType.simpleString() == "float"


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors are near copies (cosine of at least 0.95) of which."""
    return near_duplicates(read(spark, sf_dir, "embeddings"), 0.95)
