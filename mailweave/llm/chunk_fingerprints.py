"""Document fingerprints from content-defined chunks, and how much of one document stands in another.

A gear hash runs over the UTF-8 bytes of a text; it depends on the last 32 bytes only, so chunk ends follow the content and what lies behind
an insertion is cut as before.  Chunk lengths are normalised: up to ``NORMAL`` bytes an end must meet a hard condition, beyond it an easy one, and
chunks have ``LEAST`` bytes at least and ``MOST`` at most.  A fingerprint is the set of a text's chunk digests with their lengths, written in order
as one string.  The containment of one text in another is the share of its fingerprint's bytes whose chunks the other one has too.

``with_next`` lays documents next to their successor in the order of falling ids, so that both can be compared, without one global sort in one task:
texts are shuffled once into ranges of that order whose first rows are known, and the first row of a range is also sent to the end of
the range before.  A task streams over its range and holds one document back.

Cases: null texts are as empty ones; an empty text has an empty fingerprint, contained wholly in an empty one and not at all in another;
texts are cut whole, however long; rows that repeat a ``doc_id`` stand in the order of a hash of their text, rows that repeat both follow
one another; null ids come last; a single row is its own successor; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from mailweave.llm.common import read, thrifty
from mailweave.llm.shingles import mix

LEAST, NORMAL, MOST = 8, 40, 128  # bytes of a chunk
HARD_BITS, EASY_BITS = 6, 4  # leading zero bits of the hash at a chunk's end, before and beyond NORMAL
REACH = 32  # bytes that the hash depends on
DIGEST_BYTES = 6
GEAR = np.append((mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32), np.uint32(0))
APART = 256  # a byte that adds nothing, between texts
SLICE_BYTES = 1 << 20  # texts cut together
PER_RANGE = 32  # sampled keys a range


# ---- One text ------------------------------------------------------------------------------------------------

def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each place the sum of the last ``REACH`` gears, each shifted by how far back it lies; by doubling the reach."""
    h, reach = GEAR[data], 1
    while reach < REACH:
        moved = h.copy()
        moved[reach:] += h[:-reach] << np.uint32(reach)
        h, reach = moved, 2 * reach
    return h


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """For each text where its chunks end."""
    gap = np.full(REACH, APART, dtype=np.int16)
    parts = [p for t in texts for p in (np.frombuffer(t, dtype=np.uint8), gap)]
    h = gear_hashes(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)
    easy = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS)))
    hard = easy[h[easy] < np.uint32(1 << (32 - HARD_BITS))]
    # An end stands behind the byte that meets the condition.
    easy, hard, out, at = (easy + 1).tolist(), (hard + 1).tolist(), [], 0
    for t in texts:
        start, stop, ends = at, at + len(t), []
        i, j = bisect.bisect_left(hard, start), bisect.bisect_left(easy, start)
        while start < stop:
            i = bisect.bisect_left(hard, start + LEAST, i)
            if i < len(hard) and hard[i] < start + NORMAL:
                end = hard[i]
            else:
                j = bisect.bisect_left(easy, start + NORMAL, j)
                end = min(easy[j], start + MOST) if j < len(easy) else start + MOST
            start = min(end, stop)
            ends.append(start - at)
        out.append(ends)
        at = stop + REACH
    return out


def digest(chunk: bytes) -> str:
    return hashlib.blake2b(chunk, digest_size=DIGEST_BYTES).hexdigest()


def chunk_sets(texts: list[bytes]) -> list[dict[str, int]]:
    """For each text the lengths of its chunks by digest."""
    out = []
    for t, ends in zip(texts, chunk_ends(texts), strict=True):
        out.append({digest(t[a:b]): b - a for a, b in zip([0, *ends], ends, strict=False)})
    return out


def fingerprint(chunks: dict[str, int]) -> str:
    """Twelve hexadecimal digits of digest and two of length for each chunk, in order."""
    return "".join(sorted(f"{d}{n:02x}" for d, n in chunks.items()))


def chunks_of(text: str) -> dict[str, int]:
    """The chunk set that a fingerprint stands for."""
    return {text[i:i + 12]: int(text[i + 12:i + 14], 16) for i in range(0, len(text), 14)}


def containment(one: dict[str, int], other: dict[str, int]) -> float:
    """The share of the first set's bytes whose chunks are in the second."""
    if not one:
        return 0.0 if other else 1.0
    return sum(n for d, n in one.items() if d in other) / sum(one.values())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points from the start of the next text, or all of these."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


# ---- Documents and their successors --------------------------------------------------------------------------

def _key() -> tuple[Column, Column]:
    """Where a row stands: ids fall, so a row's place rises with the complement of its id; then a hash of the text."""
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return F.bitwise_not(doc_id).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")


def range_starts(docs: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Keys of rows that begin ranges of about as many rows each, the first of all rows first: from a sample by hash, ``PER_RANGE`` a range."""
    keys, total = docs.select(*_key()), docs.count()
    if not total:
        return []
    share = F.pmod(F.xxhash64(F.lit(3), "k", "h"), F.lit(1 << 30)) < int(min(1.0, PER_RANGE * ranges / total) * (1 << 30))
    sample = sorted((r.k, r.h) for r in keys.filter(share).distinct().collect())
    first = keys.filter(F.col("k") == docs.select(_key()[0]).agg(F.min("k")).first()[0]).agg(F.min(F.struct("k", "h")).alias("f")).first().f
    starts = {sample[len(sample) * i // ranges] for i in range(1, ranges) if sample}
    return [(first.k, first.h), *sorted(starts - {(first.k, first.h)})]


class Ranges:
    """Finds the range of a key, and the ranges that need a copy of a row as their last successor."""

    def __init__(self, starts: list[tuple[int, int]]):
        self.k, self.h = (np.array([s[i] for s in starts], dtype=np.int64) for i in (0, 1))
        self.before = {s: (i - 1) % len(starts) for i, s in enumerate(starts)}

    def of(self, k: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.k, k, side="left"), np.searchsorted(self.k, k, side="right")
        out = high - 1
        for a, b in {(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b}:
            here = (low == a) & (high == b)
            out[here] = a + np.searchsorted(self.h[a:b], h[here], side="right") - 1
        return out


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_BYTES:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs`` (doc_id, text)."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = range_starts(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
              "near_next double")
    if not starts:
        return spark.createDataFrame([], schema)
    dealt_schema = f"range int, copy int, k long, h long, doc_id {kind}, text string"
    arrow, dealt_arrow = (to_arrow_schema(_parse_datatype_string(s)) for s in (schema, dealt_schema))
    sent = spark.sparkContext.broadcast(Ranges(starts))

    def place(batches):
        ranges, copied = sent.value, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            k, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            n, spot = batch.num_rows, ranges.of(k, h).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(np.zeros(n, dtype=np.int32)), *batch.columns], schema=dealt_arrow)
            # The first row of a range also ends the range before; of equal rows one will do.
            for i in np.flatnonzero(np.isin(k, ranges.k)).tolist():
                key = (int(k[i]), int(h[i]))
                if key in ranges.before and key not in copied:
                    copied.add(key)
                    last = [pa.array([v], type=pa.int32()) for v in (ranges.before[key], 1)]
                    yield pa.RecordBatch.from_arrays([*last, *batch.slice(i, 1).columns], schema=dealt_arrow)

    def rows(ids: list, texts: list[str], sets: list[dict]) -> pa.RecordBatch:
        """All but the last row, each with the one behind it as its successor."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        raw = [t.encode() for t in changed]
        new = chunk_sets(raw)
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((
            ids[:-1], [len(t) for t in texts[:-1]], [hashlib.sha256(r).hexdigest() for r in raw],
            [fingerprint(s) for s in sets[:-1]], [fingerprint(s) for s in new],
            [containment(a, b) for a, b in zip(sets, new, strict=False)], [containment(a, b) for a, b in zip(sets, sets[1:], strict=False)],
        ), arrow, strict=True)], schema=arrow)

    def compare(batches):
        held = None  # (range, whether it is a copy, id, text, chunks) of the last row
        for batch in batches:
            spots, copies, ids, texts = (batch.column(c).to_pylist() for c in ("range", "copy", "doc_id", "text"))
            for a, b in _slices(texts):
                sets = chunk_sets([t.encode() for t in texts[a:b]])
                line = [*([held] if held else []), *zip(spots[a:b], copies[a:b], ids[a:b], texts[a:b], sets, strict=True)]
                begin = 0
                for i in range(len(line)):
                    # A run ends with a copy: it is the last successor of its range, and further copies of it follow.
                    if line[i][1] or i == len(line) - 1:
                        if i > begin:
                            _, _, run_ids, run_texts, run_sets = zip(*line[begin:i + 1], strict=True)
                            yield rows(list(run_ids), list(run_texts), list(run_sets))
                        begin = i + 1 if line[i][1] else i
                held = None if line[-1][1] else line[-1]

    placed = docs.select(*_key(), "doc_id", "text").mapInArrow(thrifty(place), dealt_schema)
    dealt = placed.repartitionById(len(starts), F.col("range")).sortWithinPartitions("range", "copy", "k", "h")
    return dealt.mapInArrow(thrifty(compare), schema)


def op13_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how much of it stands in that and in the next document."""
    return with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
