"""Groups of spelling variants: words one edit apart, found through PartEnum signatures of their letter multisets.

A word's letters are a binary vector with a dimension for every letter and occurrence.  Inserting or deleting a letter changes one dimension,
replacing one changes two, so words that are one edit apart have vectors at Hamming distance two at most.  Letters are partitioned into
``GROUPS`` groups of about equal use.  Two vectors at distance two differ in two groups at most: a word's signatures are its vector without two
groups, for all pairs of groups, and words of one length that are near share one of these.  Words whose lengths differ by one
differ in one dimension, so they share a signature that leaves out one group.  Words that share a signature are compared letter by letter;
a pair that shares several is counted in the first of them only, so what leaves a signature are counts and best partners by word, not pairs.

Signatures with more than ``HOT`` words are put aside, cut into blocks and compared block by block in a second step.

Cases: null and empty texts hold no words; a null ``doc_id`` is as an empty one; rows that repeat a ``doc_id`` count each; very long runs of letters
are words like others; equal counts are settled by code-point order; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import discard, read, thrifty, write_scratch
from mailweave.llm.shingles import mix

GROUPS = 6
OUT = [*combinations(range(GROUPS), 2), *((g,) for g in range(GROUPS))]  # the groups that a signature leaves out; its number is the place here
PAIRS = GROUPS * (GROUPS - 1) // 2  # signatures from this number on are for words of different lengths
LETTERS = 1000  # the most used letters, which are dealt into groups evenly
HOT = 4096  # words of a signature that are compared in one piece
CHUNK_ROWS = 65_536
PAIRS_AT_ONCE = 1 << 19
WIDTH = 48  # letters compared at once; longer words are compared as strings
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
DAMAGE = 97

SIGNED = pa.schema([("signature", pa.int64()), ("number", pa.int8()), ("word", pa.string()), ("n", pa.int64())])
MET = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string()),
                 ("signature", pa.int64()), ("number", pa.int8()), ("n", pa.int64())])
MET_SCHEMA = "word string, n_near long, best_n long, best string, signature long, number byte, n long"


# ---- Words ---------------------------------------------------------------------------------------------------

def vocabulary(docs: DataFrame, damage: int = DAMAGE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, with one letter left out wherever the run's hash says so."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A run loses a letter at most, so shorter ones cannot become words.
    run_of = F.regexp_extract_all(low, F.lit(f"([a-zÀ-ÿ]{{{least_letters},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(run_of).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % damage == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def letter_groups(words: DataFrame) -> dict[int, int]:
    """The group of each of the ``LETTERS`` most used letters: the next most used goes to the group with the least use so far."""
    used = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").count()
    load, out = [0] * GROUPS, {}
    for r in used.orderBy(F.desc("count"), "c").limit(LETTERS).collect():
        g = load.index(min(load))
        out[ord(r.c)] = g
        load[g] += r["count"]
    return out


class Vectors:
    """Words of a chunk as code points, and for each group a hash of the multiset of its letters."""

    def __init__(self, words: list[str], groups: dict[int, int]):
        self.words = words
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.start = np.cumsum(self.length) - self.length
        letters, place = np.unique(self.flat, return_inverse=True)
        value = mix(letters.astype(np.uint64) + np.uint64(1))
        group = np.array([groups.get(c, c % GROUPS) for c in letters.tolist()], dtype=np.int64)
        self.sums = np.zeros((len(words), GROUPS), dtype=np.uint64)
        some = np.flatnonzero(self.length)
        for g in range(GROUPS) if len(some) else ():
            # A sum of a random number for each letter names a multiset.
            self.sums[some, g] = np.add.reduceat(np.where(group == g, value, np.uint64(0))[place], self.start[some])

    def signatures(self) -> np.ndarray:
        """Rows x ``OUT``: hashes of the letters of all groups but those left out, and of the length where it has to be equal."""
        whole = self.sums.sum(axis=1)
        out = np.empty((len(self.words), len(OUT)), dtype=np.uint64)
        for i, gone in enumerate(OUT):
            rest = whole.copy()
            for g in gone:
                rest -= self.sums[:, g]
            out[:, i] = mix(mix(rest) + np.uint64(i) + (self.length.astype(np.uint64) << np.uint64(8) if i < PAIRS else np.uint64(0)))
        return out.view(np.int64)

    def first_common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of the first signature that words of one length share, given that they share one."""
        apart = self.sums[i] != self.sums[j]
        shared = np.stack([~np.delete(apart, gone, axis=1).any(axis=1) for gone in OUT[:PAIRS]], axis=1)
        return shared.argmax(axis=1)

    def matrix(self) -> np.ndarray:
        """The first ``WIDTH`` letters of each word."""
        width = min(WIDTH, int(self.length.max(initial=0))) + 1
        at = np.arange(width)
        inside = at < self.length[:, None]
        return np.where(inside, self.flat[np.minimum(self.start[:, None] + at, max(len(self.flat) - 1, 0))], 0)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns one word into the other."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)):] == b[same + 1:]


def near(v: Vectors, letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart; ``j`` is as long as ``i`` or one letter longer."""
    out = np.zeros(len(i), dtype=bool)
    long = (v.length[j] > WIDTH)
    for k in np.flatnonzero(long).tolist():
        out[k] = one_edit(v.words[i[k]], v.words[j[k]])
    equal = np.flatnonzero(~long & (v.length[i] == v.length[j]))
    out[equal] = (letters[i[equal]] != letters[j[equal]]).sum(axis=1) == 1
    other = np.flatnonzero(~long & (v.length[i] != v.length[j]))
    if len(other):
        one, two = letters[i[other]], letters[j[other]]
        first = (one != two).argmax(axis=1)  # they differ at the shorter one's end at the latest
        moved = one[:, :-1] != two[:, 1:]
        last = moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1)
        out[other] = ~moved.any(axis=1) | (last < first)
    return out


# ---- Signatures ----------------------------------------------------------------------------------------------

def signed(words: DataFrame, groups: dict[int, int]) -> DataFrame:
    """(signature, number, word, n): every word once for each of its signatures."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                found = Vectors(part.column(0).to_pylist(), groups).signatures()
                for i in range(len(OUT)):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, i]), pa.array(np.full(part.num_rows, i, dtype=np.int8)), *part.columns], schema=SIGNED)

    return words.select("word", "n").mapInArrow(thrifty(run), "signature long, number byte, word string, n long")


def _pairs(group: np.ndarray, number: np.ndarray, length: np.ndarray, own: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows to compare, some at a time: rows stand by group and length; ``own``: only rows of different blocks, where there are two."""
    key = group * (int(length.max()) + 2) + length
    equal = number < PAIRS
    low = np.where(equal, np.arange(len(group)) + 1, np.searchsorted(key, key + 1, side="left"))
    high = np.where(equal, np.searchsorted(group, group, side="right"), np.searchsorted(key, key + 1, side="right"))
    count = np.maximum(high - low, 0)
    ends, a = np.cumsum(count), 0
    while a < len(group):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, side="right")))
        some = count[a:b]
        i = np.repeat(np.arange(a, b), some)
        j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[a:b], some)
        if own is not None:
            keep = own[i] != own[j]
            i, j = i[keep], j[keep]
        yield i, j
        a = b


def _compared(table: pa.Table, groups: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Counts and best partners of the words of whole signatures (or of two blocks of one)."""
    words, n = table["word"].to_pylist(), np.asarray(table["n"])
    length = np.array([len(w) for w in words], dtype=np.int64)
    _, group = np.unique(np.asarray(table["signature"]), return_inverse=True)
    order = np.lexsort((length, group))
    words, n, group, number = [words[k] for k in order.tolist()], n[order], group[order], np.asarray(table["number"])[order]
    crossed = "own" in table.column_names and table["x"][0] != table["y"][0]
    own = np.asarray(table["own"])[order] if crossed else None
    v = Vectors(words, groups)
    letters, kept = v.matrix(), []
    for i, j in _pairs(group, number, v.length, own):
        hit = near(v, letters, i, j)
        i, j = i[hit], j[hit]
        first = np.where(number[i] < PAIRS, v.first_common(i, j) if len(i) else number[i], number[i])
        kept.append((i[first == number[i]], j[first == number[i]]))
    i, j = (np.concatenate([k[s] for k in kept]) for s in (0, 1))
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    if not len(i):
        return
    # Places of the partners when the most frequent stand first, equal ones in code-point order.
    rows = np.unique(j)
    ranked = sorted(rows.tolist(), key=lambda r: (-n[r], words[r]))
    place = np.empty(len(words), dtype=np.int64)
    place[ranked] = np.arange(len(ranked))
    best = np.full(len(words), len(ranked))
    np.minimum.at(best, i, place[j])
    count = np.bincount(i, minlength=len(words))
    told = np.flatnonzero(count).tolist()
    partner = [ranked[best[r]] for r in told]
    none = [None] * len(told)
    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip((
        [words[r] for r in told], count[told], n[partner], [words[r] for r in partner], none, none, none), MET, strict=True)], schema=MET)


def _set_aside(table: pa.Table) -> pa.RecordBatch:
    none = [None] * table.num_rows
    columns = {"word": table["word"].to_pylist(), "signature": table["signature"].to_pylist(), "number": table["number"].to_pylist(), "n": table["n"].to_pylist()}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, none), type=f.type) for f in MET], schema=MET)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], hot: int, chunk: int) -> Iterator[tuple[bool, pa.Table]]:
    """Tables of whole groups of ``keys``, by which rows are in order, and of parts of groups longer than a chunk (then True)."""
    held, rows, over = [], 0, None

    def cut(end: bool):
        nonlocal held, rows, over
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [np.asarray(table[k]) for k in keys]
        fresh = np.zeros(table.num_rows - 1, dtype=bool)
        for c in columns:
            fresh |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(fresh) + 1]
        last = tuple(c[-1] for c in columns)
        if over is not None and over == tuple(c[0] for c in columns):
            first = int(starts[1]) if len(starts) > 1 else table.num_rows
            yield True, table.slice(0, first)
            table, starts = table.slice(first), starts[1:] - first
        over = None
        whole = table.num_rows if end else int(starts[-1]) if len(starts) else 0
        if whole:
            yield False, table.slice(0, whole)
        if not end and table.num_rows - whole > hot or not table.num_rows:
            over = last
            if table.num_rows > whole:
                yield True, table.slice(whole)
            whole = table.num_rows
        held = table.slice(whole).to_batches() if table.num_rows > whole else []
        rows = table.num_rows - whole

    for batch in batches:
        for a in range(0, batch.num_rows, chunk):
            held.append(batch.slice(a, chunk))
            rows += held[-1].num_rows
            if rows >= chunk:
                yield from cut(False)
    if rows:
        yield from cut(True)


def near_words(words: DataFrame, hot: int = HOT, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n) with a word one edit away; best is the most frequent of these."""
    groups = letter_groups(words)

    def meet(batches):
        for aside, table in _whole(batches, ["signature"], hot, chunk):
            if aside:
                yield _set_aside(table)
                continue
            _, group, size = np.unique(np.asarray(table["signature"]), return_inverse=True, return_counts=True)
            many = size[group] > hot
            if many.any():
                yield _set_aside(table.filter(pa.array(many)))
            some = ~many & (size[group] > 1)
            if some.any():
                yield from _compared(table.filter(pa.array(some)), groups)

    def meet_blocks(batches):
        for _, table in _whole(batches, ["signature", "x", "y"], 2 * chunk, chunk):
            where = np.stack([np.asarray(table[c]) for c in ("signature", "x", "y")])
            starts = np.r_[0, np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1, table.num_rows].tolist()
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                yield from _compared(table.slice(a, b - a), groups)

    dealt = signed(words, groups).repartition("signature").sortWithinPartitions("signature")
    met = write_scratch(dealt.mapInArrow(thrifty(meet), MET_SCHEMA), "near-words")
    aside = met.filter("signature is not null").select("signature", "number", "word", "n")
    # Half of it a block, so that two blocks are compared in one piece.
    blocks = aside.groupBy("signature").agg(F.ceil(F.count("*") / (hot // 2)).cast("int").alias("blocks"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
    cut = aside.join(blocks, "signature").withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int")).withColumn("p", F.explode(every))
    cut = cut.select("signature", "p.x", "p.y", "own", "number", "word", "n")
    keys = ("signature", "x", "y")
    again = cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(thrifty(meet_blocks), MET_SCHEMA)
    told = met.filter("signature is null").unionByName(again)
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best")))
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.least")).alias("best_n"), "b.best")


# ---- Groups --------------------------------------------------------------------------------------------------

def roots(links: DataFrame) -> DataFrame:
    """(word, root) of every word of ``links`` (word, form), where forms lead to no circle: the distance followed doubles each round."""
    now = write_scratch(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = write_scratch(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = after.select("word", "root")
        now.scratch = after.scratch
        if after.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n): its more usual form, and the end of the chain of forms."""
    known = write_scratch(words, "vocabulary")
    named = F.col("best_n") >= ratio * F.col("n")
    told = write_scratch(known.join(near_words(known), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(named, F.col("best")).alias("form"),
        F.when(named, F.col("best_n")).alias("form_n")), "variants")
    discard(known)
    end = roots(told.filter("form is not null"))
    return told.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spelling variants among the words of all documents."""
    return variants(vocabulary(read(spark, sf_dir, "documents")))


# The polynomial of crc32 in its reflected form.
_CRC_STEP = "list_reduce(range(9), lambda a, b: CASE WHEN b = 0 THEN a WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT)"
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100))
_ASCII = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'")[:64]

OP12_SQL = f"""WITH RECURSIVE crc AS (SELECT list({_CRC_STEP} ORDER BY i) AS t FROM range(256) r(i)),
docs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+') AS runs FROM documents),
runs AS (SELECT doc, run, count(*) AS m FROM (SELECT doc, unnest(runs) AS run FROM docs) WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, m, xor(list_reduce(list_transform(range(strlen(doc || run) + 1),
      lambda i: ('0x' || substr(hex(encode(doc || ':' || run)), 2 * i + 1, 2))::BIGINT),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM runs, crc),
vocabulary AS (SELECT word, sum(m)::BIGINT AS n FROM (
    SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
holes AS (SELECT DISTINCT word, n, substr(word, 1, i) || substr(word, i + 2) AS hole FROM vocabulary, unnest(range(length(word))) u(i)
  UNION ALL SELECT word, n, word FROM vocabulary),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b USING (hole)
  WHERE a.word <> b.word AND levenshtein(translate(a.word, '{_LATIN}', '{_ASCII}'), translate(b.word, '{_LATIN}', '{_ASCII}')) = 1),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
told AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
    CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS at FROM told WHERE form IS NOT NULL
  UNION ALL SELECT w.word, t.form FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NOT NULL),
ends AS (SELECT w.word, w.at FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NULL)
SELECT t.word, t.form, coalesce(e.at, t.word) AS root, t.n, t.n_near, t.form_n FROM told t LEFT JOIN ends e USING (word)"""
