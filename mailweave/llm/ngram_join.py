"""Jaccard self-join on word shingles, filtered by prefixes under several global orders.

A set of n shingles that is similar to another must share s shingles with it among its first n - ceil(t n) + s, under any order of all
shingles.  The first order takes rare shingles first (by a counting sketch of the whole corpus, fixed in size), with s = n / 32; two
more are plain hash orders with s = 1.

1. Texts of equal shingle sets are one class, known by its smallest ``doc_id``.
2. Prefixes under the first order are posted.  Documents with fewer than s shingles that other classes post too are done.  Of the
   others each is a member of the *canopy* of the smallest document that posts a shingle with it.  Of two similar documents either
   may leave out (s - 1) / 2 of its shared shingles, the most common ones, and they still meet.  A document enters each canopy once,
   so a group of m copies makes about m rows, not m^2 pairs.
3. The sets of canopy members are made again from their texts.  In a canopy, pairs that share a prefix shingle under each further
   order are verified exactly, in blocks of bounded size, and leave as a spanning forest of the links found.
4. Connected components over classes give every document its component.

Cases: null, empty and blank texts have empty sets and are linked with nothing; with fewer words than a shingle the whole sequence
is the only shingle; equal sets are linked; rows that repeat a ``doc_id`` are one node with the links of all its rows; rows with a
null ``doc_id`` take no part and get a null component; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import (discard, has_bit, id_bits, id_spot, map_batches, read, small_batches, split_by_id, thrifty,
                                  write_scratch)
from mailweave.llm.rows import named, told_apart, without
from mailweave.llm.components import components
from mailweave.llm.grouped import deal, groups
from mailweave.llm.shingles import mix, shingles

SKETCH_BITS = 19  # counters of the corpus sketch: 2^19 of four bytes, whatever the corpus
SKETCH_PART = 4096
BLOCK_ROWS = 1000  # documents of one block of a canopy
BLOCK_SHINGLES = 1 << 20
COLUMNS_AT_ONCE = 4096
ORDERS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def prefix_length(n: int, percent: int, shared: int = 1) -> int:
    """Sets of n that are similar to another share at least ceil(percent n / 100) shingles with it, ``shared`` of them in the prefix."""
    return n - -(-percent * n // 100) + shared


def needed(n):
    """How many shared shingles the first order asks for; works on numbers and columns."""
    return F.greatest(F.lit(1), F.floor(n / 32)) if not isinstance(n, int) else max(1, n // 32)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each hash bucket occur in the whole corpus; counters are added up in parts by Spark."""

    def count(batches):
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            made, _ = shingles(batch.column(0), k)
            total += np.bincount((made >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        parts = total.astype("<u4").reshape(-1, SKETCH_PART)
        yield pa.RecordBatch.from_pydict({"part": list(range(len(parts))), "counts": [p.tobytes() for p in parts]},
                                         schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, dtype="<u4").astype(np.int64)
        yield pa.RecordBatch.from_pydict(
            {"part": list(sums), "counts": [np.minimum(s, 2**32 - 1).astype("<u4").tobytes() for s in sums.values()]},
            schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    schema = "part int, counts binary"
    rows = small_batches(docs.select("text")).mapInArrow(thrifty(count), schema).repartition("part").mapInArrow(thrifty(add), schema).collect()  # 2 MB at most
    total = np.zeros((1 << SKETCH_BITS) // SKETCH_PART * SKETCH_PART, dtype=np.uint32)
    for r in rows:
        total[r.part * SKETCH_PART:(r.part + 1) * SKETCH_PART] = np.frombuffer(r.counts, dtype="<u4")
    return total


def rare_first(made: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The first shingles in the order of the corpus counts, ties by hash."""
    rank = counts[(made >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32) | mix(made) >> np.uint64(32)
    return made[np.argpartition(rank, length - 1)[:length]] if length < len(made) else made


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, class_a, class_b, prefix): the class is a 128-bit sum over the set."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch(docs, k))

    def run(batch):
        made, cuts = shingles(batch.column(1), k)
        n, a, b, prefix = [], [], [], []
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = np.unique(made[i:j])
            n.append(len(own))
            a.append(int(mix(own ^ ORDERS[0]).sum().view(np.int64)))
            b.append(int(mix(own ^ ORDERS[1]).sum().view(np.int64)))
            prefix.append(rare_first(own, counts.value, prefix_length(len(own), percent, needed(len(own)))).view(np.int64) if len(own) else [])
        return {"doc_id": batch.column(0), "n_shingles": n, "class_a": a, "class_b": b, "prefix": prefix}

    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(typed, "doc_id long, n_shingles long, class_a long, class_b long, prefix array<long>", run)


def classes_of(sized: DataFrame) -> DataFrame:
    """(class_a, class_b, first_id, n_shingles) of the sets that are not empty."""
    return sized.filter("n_shingles > 0 and doc_id is not null").groupBy("class_a", "class_b").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.min("n_shingles").alias("n_shingles"))


def one_of_each(posted: DataFrame, classes: DataFrame) -> DataFrame:
    """Prefixes of the first document of each class.  Only those that may be later copies are moved to find out."""
    copied = classes.filter("first_id < last_id").select("class_a", "class_b", "first_id")
    later = posted.select("doc_id", "class_a", "class_b").join(copied, ["class_a", "class_b"]).filter("doc_id > first_id").select("doc_id", "class_a", "class_b")
    rows = posted.filter("doc_id is not null and n_shingles > 0").select("doc_id", "class_a", "class_b", "prefix")
    sure, maybe = split_by_id(rows, later)
    return sure.unionByName(maybe.join(later, ["doc_id", "class_a", "class_b"], "left_anti").select(*rows.columns)).select("doc_id", "prefix")


def canopies(firsts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(leader, doc_id, n_shingles): documents that may be similar to others, under the leaders they meet them with.

    ``firsts``: (doc_id, prefix); ``sizes``: (doc_id, n_shingles).
    """
    rows = firsts.select(F.explode("prefix").alias("shingle"), "doc_id")
    # Least ids and counts combine before the shuffle; the join below is on the shingle and may be split where one is hot.
    met = rows.groupBy("shingle").agg(F.min("doc_id").alias("leader"), F.count("*").alias("times")).filter("times > 1")
    # A document's list is bounded by its own prefix.
    own = rows.join(met, "shingle").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("times", "leader"))).alias("met"))
    own = own.join(sizes, "doc_id").filter(F.size("met") >= needed(F.col("n_shingles")))
    stay = F.slice("met", F.lit(1), F.size("met") - F.floor((needed(F.col("n_shingles")) - 1) / 2).cast("int"))
    return own.select(F.explode(F.array_distinct(stay["leader"])).alias("leader"), "doc_id", "n_shingles").distinct()


def member_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of the members, and of few others whose hash meets theirs; texts do not move."""
    bits = docs.sparkSession.sparkContext.broadcast(id_bits(members))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", id_spot())

    def run(batch):
        part = batch.filter(pa.array(has_bit(bits.value, np.asarray(batch.column(2)))))
        made, cuts = shingles(part.column(1), k)
        sets = [np.unique(made[i:j]).astype("<u8").tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return {"doc_id": part.column(0), "shingles": sets}

    return map_batches(rows, "doc_id long, shingles binary", run)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; shingles of one set only need no column."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    value, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    stay = seen[column] > 1
    renamed = np.cumsum(seen > 1) - 1
    row, column = row[stay], renamed[column[stay]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int((seen > 1).sum()), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [start, start + COLUMNS_AT_ONCE])
        width = int(column[b - 1]) - start + 1
        block = np.zeros((n, width), dtype=np.float32)
        block[row[a:b], column[a:b] - start] = 1
        out += block @ block.T
    return out


def links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Boolean matrix of the similar pairs: length filter, prefixes under each order, then the exact comparison."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    may = 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)
    for salt in ORDERS:
        heads = []
        for s in sets:
            rank = mix(s ^ salt)
            length = prefix_length(len(s), percent)
            heads.append(s[np.argpartition(rank, length - 1)[:length]] if length < len(s) else s)
        may &= _shared(heads) > 0
    np.fill_diagonal(may, False)
    found = np.zeros_like(may)
    left = np.flatnonzero(may.any(axis=1))  # sets without a candidate are done
    if len(left):
        both = _shared([sets[i] for i in left]).astype(np.int64)
        size = n[left]
        similar = 100 * both >= percent * (size[:, None] + size - both)
        found[np.ix_(left, left)] = similar & may[np.ix_(left, left)]
    return found


def spanning_forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Edges (child, parent) that connect what the matrix connects."""
    edges, new = [], np.ones(len(found), dtype=bool)
    for root in range(len(found)):
        if not new[root]:
            continue
        new[root], queue = False, [root]
        while queue:
            at = queue.pop()
            reached = np.flatnonzero(found[at] & new)
            new[reached] = False
            edges.extend((int(r), at) for r in reached)
            queue.extend(reached.tolist())
    return edges


def canopy_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span what is connected in each canopy; ``members``: (leader, doc_id, n_shingles)."""
    size = members.groupBy("leader").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("all"))
    n_blocks = F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("all") / BLOCK_SHINGLES)).cast("int")
    size = size.filter("rows > 1").select("leader", n_blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(F.col("own"), j).alias("x"), F.greatest(F.col("own"), j).alias("y")))
    placed = members.join(size, "leader").withColumn("own", own).select("leader", "doc_id", F.explode(pairs).alias("p"))
    rows = deal(placed.select("leader", "p.x", "p.y", "doc_id").join(sets, "doc_id").select("leader", "x", "y", "doc_id", "shingles"),
                "leader", "x", "y")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for _, table in groups(batches, ["leader", "x", "y"]):
            ids = np.asarray(table.column("doc_id").to_numpy())
            found = links([np.frombuffer(s, dtype="<u8") for s in table.column("shingles").to_pylist()], percent) if len(ids) > 1 else ()
            edges = spanning_forest(found) if len(ids) > 1 else []
            if edges:
                at = np.array(edges)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], schema=arrow)

    return small_batches(rows).mapInArrow(thrifty(run), "a long, b long")


def similar_components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    posted = write_scratch(prefixes(docs, k, percent), "shingle-prefixes")
    sized = write_scratch(posted.select("doc_id", "n_shingles", "class_a", "class_b"), "shingle-classes")
    classes = classes_of(sized)
    sizes = classes.select(F.col("first_id").alias("doc_id"), "n_shingles")
    members = write_scratch(canopies(one_of_each(posted, classes), sizes), "canopies")
    discard(posted)
    sets = write_scratch(member_sets(docs, members.select("doc_id").distinct(), k), "shingle-sets")
    edges = write_scratch(canopy_links(members, sets, percent).distinct(), "shingle-links")
    discard(sets)
    joined = components(edges)
    named = classes.join(joined.withColumnRenamed("id", "first_id"), "first_id", "left").select(
        "class_a", "class_b", F.coalesce("component_id", "first_id").alias("component_id"))
    out = sized.join(named, ["class_a", "class_b"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def one_of_each_component(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Rows of ``docs`` without those that are similar, directly or through others, to a document of a smaller id.

    Rows that share an id, or have none, are documents of their own if their texts differ; of equal rows under one id one stays.  Of similar
    documents the one with the smallest id stays, then that of the least hash of its text; those without an id come last.
    """
    plain, odd = told_apart(docs)
    found = write_scratch(similar_components(named(plain, odd), k, percent).select(F.col("doc_id").alias("name"), "component_id"), "similar-rows")
    others = found.filter("name <> component_id").distinct()
    members = others.unionByName(others.select(F.col("component_id").alias("name"), "component_id").distinct())
    # Names made from hashes say nothing about the order of ids.
    known = odd.select("name", F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("made", F.lit(True))
    whose = members.join(known, "name", "left").withColumn("doc_id", F.when(F.col("made"), F.col("doc_id")).otherwise(F.col("name")))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("name"))
    first = whose.groupBy("component_id").agg(F.min_by("name", place).alias("stays"))
    gone = members.join(first, "component_id").filter("name <> stays").select(F.col("name").alias("doc_id"))
    return without(plain, odd, gone)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents share at least 85 % of their 4-word shingles, as components."""
    return similar_components(read(spark, sf_dir, "documents"), 4, 85)
