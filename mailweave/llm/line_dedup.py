"""Line dedup whose state can be taken back: exact reference counts behind sharded cuckoo filters.

State, three tables that only grow by what a batch brings:

* ``postings`` (shard, key, doc_id): which document holds which line key; the exact ground for everything else;
* ``refs`` (shard, key, n_docs, owner): reference counts, ``owner`` being the smallest document;
* ``filters`` (shard, seen, seen_stash, repeated, repeated_stash): two cuckoo filters a shard, over keys with at least one and
  with at least two documents.

A line key is the line without blanks at both ends and with A-Z in lower case, known by its MD5.  Only keys of at least
``min_chars`` code points count.  A line whose key is found in two documents or more stays in the smallest ``doc_id`` holding it.

Cases: a null or empty text is one empty line; rows with a null ``doc_id`` are kept whole and counted nowhere; rows that repeat
a ``doc_id`` are one document (all its rows keep or lose the same lines); an empty table gives an empty state; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import columns, map_batches, read, small_batches, thrifty, write_scratch
from mailweave.llm.cuckoo import LOAD, CuckooFilter, as_keys

MIN_CHARS = 10
KEYS_PER_SHARD = 100_000
PIECES = 16  # a shard is probed by this many tasks, so that one common line does not meet one task
BLANKS = " \t\n\x0b\x0c\r"
STRIPPED = BLANKS.encode()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTERS = "shard int, seen binary, seen_stash binary, repeated binary, repeated_stash binary"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(line: Column, min_chars: int) -> Column:
    """Null for lines too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@dataclass
class LineState:
    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, shards: int) -> LineState:
        return cls(spark.createDataFrame([], "shard int, key binary, doc_id long"),
                   spark.createDataFrame([], "shard int, key binary, n_docs long, owner long"),
                   spark.createDataFrame([], FILTERS), shards)


def shards_for(docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD, lines_per_doc: int = 16) -> int:
    """How many shards suit this many documents; the count reads no text."""
    return max(1, docs.count() * lines_per_doc // keys_per_shard)


def key_hashes(text: str | None, min_chars: int) -> set[bytes]:
    """The same keys in Python: MD5 of each line that counts, once."""
    found = set()
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(STRIPPED).lower()  # bytes know no letters but A-Z
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            found.add(hashlib.md5(key, usedforsecurity=False).digest())
    return found


def postings(docs: DataFrame, shards: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(shard, key, doc_id), once for each key of a document."""

    def run(batch):
        keys, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = key_hashes(text, min_chars)
            keys.extend(own)
            ids.extend([doc_id] * len(own))
        return {"key": keys, "doc_id": ids}

    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(rows, "key binary, doc_id long", run).select(F.pmod(F.hash("key"), F.lit(shards)).alias("shard"), "key", "doc_id").distinct()


def count_refs(posted: DataFrame) -> DataFrame:
    """Partial counts are made before the shuffle, so a line of very many documents is one row of each map task."""
    return posted.groupBy("shard", "key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("owner"))


def _probe(rows: DataFrame, filters: DataFrame, which: str) -> DataFrame:
    """Rows (shard, key, ...) with ``maybe``: does the shard's filter know the key?

    Filters and rows are dealt by (shard, piece) and sorted, the filter first; a task streams through them and holds one filter.
    """
    names = [c for c in rows.columns if c not in ("shard", "key")]
    spread = F.pmod(F.xxhash64("key", *names), F.lit(PIECES)).cast("int")
    right = rows.withColumn("piece", spread).withColumn("blob", F.lit(None).cast("binary")).withColumn("stash", F.col("blob"))
    left = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("piece"), F.col(which).alias("blob"),
                          F.col(f"{which}_stash").alias("stash"))
    both = right.unionByName(left, allowMissingColumns=True).withColumn("late", F.col("blob").isNull())
    dealt = both.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "late")
    schema = rows.select("shard", "key", *names, F.lit(True).alias("maybe")).schema

    def run(batches):
        filter_, at = None, None
        for batch in batches:
            shard, piece = np.asarray(batch.column("shard")), np.asarray(batch.column("piece"))
            late = np.asarray(batch.column("late").to_numpy(zero_copy_only=False))
            where = shard.astype(np.int64) * PIECES + piece
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | ~late[1:] | ~late[:-1]]).tolist() + [len(where)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if not late[a]:
                    filter_, at = CuckooFilter.load(batch.column("blob")[a].as_py(), batch.column("stash")[a].as_py()), where[a]
                    continue
                part = batch.slice(a, b - a)
                keys = as_keys(part.column("key").to_pylist())
                known = filter_.contains(keys) if filter_ is not None and at == where[a] else np.zeros(b - a, dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("shard", "key", *names)] + [pa.array(known)], names=["shard", "key", *names, "maybe"])

    return small_batches(dealt).mapInArrow(thrifty(run), schema)


def _grow_filters(filters: DataFrame, changes: DataFrame, room: int = 1) -> DataFrame:
    """Apply (shard, key, change) to the filters; changes: seen+, repeated+, seen-, repeated-.

    Keys come once for each change, so a shard's group is bounded by its share of distinct keys whatever the texts repeat.  A shard
    without a filter gets one with room for ``room`` times its keys.
    """

    def apply(shard, old, new):
        import pandas as pd

        def grown(which):
            add = as_keys(list(new.key[new.change == which + "+"]))
            gone = as_keys(list(new.key[new.change == which + "-"]))
            if len(old) and len(old[which].iloc[0]):
                filter_ = CuckooFilter.load(old[which].iloc[0], old[which + "_stash"].iloc[0])
            else:
                filter_ = CuckooFilter.sized(room * len(add))
            filter_.delete(gone)
            filter_.insert(add)
            return filter_.dump()

        seen, repeated = grown("seen"), grown("repeated")
        return pd.DataFrame({"shard": [shard[0]], "seen": [seen[0]], "seen_stash": [seen[1]], "repeated": [repeated[0]],
                             "repeated_stash": [repeated[1]]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, FILTERS)


def _changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What two reference tables say the filters must add and drop."""
    a = before.select("shard", "key", F.col("n_docs").alias("was"))
    b = after.select("shard", "key", "n_docs")
    both = a.join(b, ["shard", "key"], "full").withColumn("was", F.coalesce("was", F.lit(0))).withColumn(
        "n_docs", F.coalesce("n_docs", F.lit(0)))
    steps = F.array_compact(F.array(
        F.when((F.col("was") < 1) & (F.col("n_docs") >= 1), "seen+"), F.when((F.col("was") >= 1) & (F.col("n_docs") < 1), "seen-"),
        F.when((F.col("was") < 2) & (F.col("n_docs") >= 2), "repeated+"),
        F.when((F.col("was") >= 2) & (F.col("n_docs") < 2), "repeated-")))
    return both.select("shard", "key", F.explode(steps).alias("change"))


def _all_steps(refs: DataFrame) -> DataFrame:
    """(shard, key, change) that build the filters of a reference table from nothing."""
    steps = F.when(F.col("n_docs") > 1, F.array(F.lit("seen+"), F.lit("repeated+"))).otherwise(F.array(F.lit("seen+")))
    return refs.select("shard", "key", F.explode(steps).alias("change"))


def crowded_shards(filters: DataFrame, refs: DataFrame) -> DataFrame:
    """(shard): filters whose tables are too small for the keys that the reference table has now."""
    held = refs.groupBy("shard").agg(F.count("*").alias("n_seen"), F.count_if(F.col("n_docs") > 1).alias("n_repeated"))
    slots = lambda which: F.octet_length(which) / 2
    sized = filters.select("shard", slots("seen").alias("seen"), slots("repeated").alias("repeated"))
    return sized.join(held, "shard").filter((F.col("n_seen") > LOAD * F.col("seen")) | (F.col("n_repeated") > LOAD * F.col("repeated"))).select("shard")


def _updated_filters(filters: DataFrame, changes: DataFrame, refs: DataFrame) -> DataFrame:
    """The filters after some changes to ``refs``, the table as it is now; crowded ones are built again from it, twice as large."""
    full = write_scratch(crowded_shards(filters, refs), "line-crowded")
    again = _grow_filters(filters.limit(0), _all_steps(refs.join(full, "shard", "left_semi")), room=2)
    changes = changes.join(full, "shard", "left_anti")
    stay = filters.join(full, "shard", "left_anti")
    grown = write_scratch(_grow_filters(stay.join(changes.select("shard").distinct(), "shard", "left_semi"), changes), "line-filters-grown")
    untouched = stay.join(grown.select("shard"), "shard", "left_anti")
    return write_scratch(untouched.unionByName(grown).unionByName(again), "line-filters")


def resharded(state: LineState, keys_per_shard: int = KEYS_PER_SHARD) -> LineState:
    """The same state in twice as many shards, and again, until none has more than twice ``keys_per_shard`` keys on average."""
    keys, shards = state.refs.count(), state.shards
    while keys > 2 * keys_per_shard * shards:
        shards *= 2
    if shards == state.shards:
        return state
    at = F.pmod(F.hash("key"), F.lit(shards))
    refs = write_scratch(state.refs.withColumn("shard", at), "line-refs")
    filters = write_scratch(_grow_filters(state.filters.limit(0), _all_steps(refs)), "line-filters")
    return LineState(state.postings.withColumn("shard", at), refs, filters, shards)


def insert(state: LineState, docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> LineState:
    """Add documents.  Keys the ``seen`` filters have never met need no look into the stored tables; only the others do.

    Filters that get crowded are built again at twice the size from the reference counts, and shards are split as the keys grow.
    """
    fresh = write_scratch(postings(docs, state.shards, min_chars), "line-postings")
    met = _probe(fresh, state.filters, "seen")
    old = met.filter("maybe").join(state.postings, ["shard", "key", "doc_id"], "left_anti").select("shard", "key", "doc_id")
    added = met.filter("not maybe").select("shard", "key", "doc_id").unionByName(old)
    counted = write_scratch(count_refs(added), "line-refs-batch")
    touched = state.refs.join(counted.select("shard", "key"), ["shard", "key"], "left_semi")
    merged = touched.unionByName(counted).groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs"), F.min("owner").alias("owner"))
    untouched = state.refs.join(counted.select("shard", "key"), ["shard", "key"], "left_anti")
    refs = write_scratch(untouched.unionByName(merged), "line-refs")
    filters = _updated_filters(state.filters, _changes(touched, merged), refs)
    return resharded(LineState(state.postings.unionByName(added), refs, filters, state.shards), keys_per_shard)


def first_state(docs: DataFrame, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> LineState:
    """``insert`` into an empty state: every key is new, so the batch's own counts are the reference table."""
    shards = shards_for(docs, keys_per_shard)
    posted = write_scratch(postings(docs, shards, min_chars), "line-postings")
    refs = write_scratch(count_refs(posted), "line-refs")
    filters = _grow_filters(LineState.empty(docs.sparkSession, shards).filters, _all_steps(refs))
    return LineState(posted, refs, write_scratch(filters, "line-filters"), shards)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """Take documents back: counts fall, owners move on, and keys nobody holds leave the filters."""
    gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    keys = state.postings.join(gone, "doc_id", "left_semi").select("shard", "key").distinct()
    posted = write_scratch(state.postings.join(gone, "doc_id", "left_anti").select("shard", "key", "doc_id"), "line-postings")
    touched = state.refs.join(keys, ["shard", "key"], "left_semi")
    now = count_refs(posted.join(keys, ["shard", "key"], "left_semi"))
    refs = write_scratch(state.refs.join(keys, ["shard", "key"], "left_anti").unionByName(now), "line-refs")
    return LineState(posted, refs, _updated_filters(state.filters, _changes(touched, now), refs), state.shards)


def losses(state: LineState) -> DataFrame:
    """(doc_id, drops): the keys whose lines a document loses.

    The ``repeated`` filters let only keys through that may have two documents; the reference counts decide.
    """
    maybe = _probe(state.postings, state.filters, "repeated").filter("maybe")
    shared = state.refs.filter("n_docs > 1").select("shard", "key", "owner")
    lost = maybe.join(shared, ["shard", "key"]).filter("doc_id <> owner")
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("drops"))


def kept_lines(text: Column, drops: Column, min_chars: int = MIN_CHARS) -> Column:
    gone = lambda line: F.coalesce(F.array_contains(drops, key_hash(line, min_chars)), F.lit(False))
    return F.filter(lines(text), lambda line: ~gone(line))


def with_kept(docs: DataFrame, state: LineState, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` as ``struct row`` with ``kept`` (text), ``n_lines`` and ``n_dropped``; documents without losses keep their text."""
    rows = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("_id"))
    met = rows.join(losses(state).withColumnRenamed("doc_id", "_id"), "_id", "left")
    text, whole = F.col("row.text"), F.coalesce(F.col("row.text"), F.lit(""))
    stay = F.when(F.col("drops").isNotNull(), kept_lines(text, F.col("drops"), min_chars))
    met = met.select("row", stay.alias("stay"), (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    return met.select("row", F.coalesce(F.array_join("stay", "\n"), F.col("row.text"), F.lit("")).alias("kept"), "n_lines",
                      F.coalesce(F.col("n_lines") - F.size("stay"), F.lit(0)).cast("long").alias("n_dropped"))


def rewritten(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the kept lines as ``text``; ``n_chars``, where there is such a column, follows."""
    kept = with_kept(docs, first_state(docs, min_chars), min_chars)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
           "n_chars": F.when(changed, F.length("kept")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps when lines found in several documents stay in the first only."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = with_kept(docs, first_state(docs))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, s.owner IS NOT NULL AND s.owner <> k.doc_id AS dropped FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
