"""Masked pseudo-likelihood of texts from a bidirectional window network trained in numpy.

Tokens are blank-separated words, A-Z lower-cased.  There are as many buckets for their hashes as the corpus has distinct words, to the next power of
two.  The network sees the ``WINDOW`` words on either side of a place, never the word itself, and predicts the word's bucket.  Buckets
are numbered by how often they occur, and a number is predicted digit by digit: for every digit a soft-max over ``BASE`` values whose
logits are the log shares of each value, given the digits before, plus what the words around add.  The product of the digits'
probabilities is the word's, so all words are told apart at the price of some short soft-maxes, and an untrained network gives the
corpus shares.  A text's score is the sum of the log-probabilities of all its words.

Two things are gathered from the whole corpus by Spark: the counts of all words' buckets, added up as a table, and the weights.  Every
partition trains once on all its texts from common weights and gives its weights back; their mean, by words seen, is the network.
Vocabulary, context classes (the root of the vocabulary) and with them the weights grow with the corpus; no more than one table of
counts and one of weights reach the driver.  As partitions learn apart, weights depend on how the table is cut into files.

Cases: null, empty and blank texts have no words, score 0 and no mean; ids are not looked at, so repeated rows are scored each and rows with
a null ``doc_id`` are scored too; texts of any length are scored whole; words that never occurred in the counted corpus have the share of a
single occurrence; on an empty table the result is empty; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import map_batches, read, small_batches, thrifty
from mailweave.llm.shingles import words

MOST_BITS, LEAST_BITS = 24, 12  # of the number of buckets; words are counted in the most
BASE_BITS = 4
BASE = 1 << BASE_BITS
WINDOW = 2
HIDDEN = 24
PLACES = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
BATCH = 2048
RATE = 0.05
AT_ONCE = 2048  # words scored together
PART = 4096
SEED = 23
NEVER = np.float32(-1e30)
MOST_SHIFT = np.float32(80)  # what the words around may add to a logit
PARTS_SCHEMA = "part int, seen double, value binary"
PARTS_ARROW = pa.schema([("part", pa.int32()), ("seen", pa.float64()), ("value", pa.binary())])


def _summed(docs: DataFrame, per_partition, size: int) -> tuple[np.ndarray, float]:
    """Sum of the vectors that partitions give, in parts; only the sum reaches the driver."""

    def emit(batches):
        seen, vector = per_partition(batches)
        if seen:
            for p in range(0, size, PART):
                yield pa.RecordBatch.from_pydict({"part": [p // PART], "seen": [float(seen)], "value": [vector[p:p + PART].astype("<f4").tobytes()]},
                                                 schema=PARTS_ARROW)

    def add(batches):
        sums, seen = {}, {}
        for batch in batches:
            for part, n, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[part] = sums.get(part, 0.0) + np.frombuffer(value, dtype="<f4").astype(np.float64)
                seen[part] = seen.get(part, 0.0) + n
        yield pa.RecordBatch.from_pydict({"part": list(sums), "seen": list(seen.values()), "value": [v.astype("<f8").tobytes() for v in sums.values()]},
                                         schema=PARTS_ARROW)

    rows = small_batches(docs).mapInArrow(thrifty(emit), PARTS_SCHEMA).repartition("part").mapInArrow(thrifty(add), PARTS_SCHEMA).collect()
    total, seen = np.zeros(size), 0.0
    for r in rows:
        vector = np.frombuffer(r.value, dtype="<f8")
        total[r.part * PART:r.part * PART + len(vector)] = vector
        seen = r.seen
    return total, seen


def buckets(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and the row that it stands in; fewer bits give the first bits of more."""
    hashed, row = words(texts)
    return (hashed >> np.uint64(64 - bits)).astype(np.int64), row


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the whole corpus; as many buckets as the corpus asks for."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        held = []
        for batch in batches:
            held.append(np.unique(buckets(batch.column(0), MOST_BITS)[0], return_counts=True))
            if sum(len(h[0]) for h in held) > 1 << 20:
                held = [_added(held)]
        if held:
            found, n = _added(held)
            yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.int32()), pa.array(n)], schema=schema)

    counted = small_batches(docs.select("text")).mapInArrow(thrifty(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    found, n = np.asarray(counted.column("bucket")).astype(np.int64), np.asarray(counted.column("n"))
    bits = min(MOST_BITS, max(LEAST_BITS, int(len(found) - 1).bit_length())) if len(found) else LEAST_BITS
    return np.bincount(found >> (MOST_BITS - bits), n, minlength=1 << bits)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return found, np.bincount(place, np.concatenate([h[1] for h in held]), minlength=len(found)).astype(np.int64)


class Vocabulary:
    """Numbers of buckets, the most frequent first, and for every run of leading digits the log shares of each next digit."""

    def __init__(self, counts: np.ndarray):
        self.bits = len(counts).bit_length() - 1
        self.digits = -(-self.bits // BASE_BITS)
        order = np.argsort(-counts, kind="stable")
        self.number = np.empty(len(counts), dtype=np.int32)
        self.number[order] = np.arange(len(counts), dtype=np.int32)
        below, self.logits = np.sort(counts)[::-1] + 1.0, []
        for _ in range(self.digits):
            rows = np.zeros(-(-len(below) // BASE) * BASE)
            rows[:len(below)] = below
            rows = rows.reshape(-1, BASE)
            below = rows.sum(axis=1)
            self.logits.insert(0, np.where(rows > 0, np.log(np.maximum(rows, 1e-300) / below[:, None]), NEVER).astype(np.float32))
        # Context classes: the most frequent words have their own, the others share by number.
        self.contexts = 1 << -(-self.bits // 2)
        self.own = self.contexts // 2

    def context(self, number: np.ndarray) -> np.ndarray:
        return np.where(number < self.own, number, self.own + number % (self.contexts - self.own))


class WindowNetwork:
    """Per-place embeddings of context classes summed into one rectified layer; a soft-max for each digit.  All weights stand in one vector."""

    def __init__(self, contexts: int, digits: int, vector: np.ndarray | None = None):
        self.contexts, self.digits = contexts, digits
        shapes = [(len(PLACES) * (contexts + 1), HIDDEN), (HIDDEN,), (HIDDEN, digits * BASE)]
        sizes = [int(np.prod(s)) for s in shapes]
        self.size = sum(sizes)
        if vector is None:
            rng = np.random.default_rng(SEED)
            # Nothing is added to the logits at first.
            vector = np.concatenate([rng.standard_normal(sizes[0]) / np.sqrt(len(PLACES)), np.zeros(sizes[1] + sizes[2])])
        self.vector = vector.astype(np.float32)
        cuts = np.cumsum([0, *sizes])
        self.near, self.bias, self.out = (self.vector[a:b].reshape(s) for a, b, s in zip(cuts, cuts[1:], shapes, strict=False))
        self.squares = [np.full(s, 1e-6, dtype=np.float32) for s in shapes]

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """``around``: places x words, rows of ``near``."""
        total = self.near[around[0]] + self.bias
        for place in range(1, len(PLACES)):
            total += self.near[around[place]]
        return np.maximum(total, 0, out=total)

    def weighed(self, hidden: np.ndarray, number: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Unscaled shares of each digit's values (a row a word and digit), their sums, where the words' own lie, and log-probabilities."""
        rows = (hidden @ self.out).reshape(-1, BASE)
        np.clip(rows, -MOST_SHIFT, MOST_SHIFT, out=rows)
        own = np.arange(0, rows.size, BASE).reshape(-1, self.digits)
        for d, table in enumerate(vocabulary.logits):
            part = number >> (BASE_BITS * (self.digits - 1 - d))
            rows[d::self.digits] += table[part >> BASE_BITS]
            own[:, d] += part & (BASE - 1)
        own = own.ravel()
        chosen = rows.ravel()[own]
        np.exp(rows, out=rows)
        total = rows @ np.ones(BASE, dtype=np.float32)
        return rows, total, own, chosen - np.log(total)

    def log_probability(self, around: np.ndarray, number: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        each = self.weighed(self.hidden(around), number, vocabulary)[3]
        return each.reshape(-1, self.digits).sum(axis=1, dtype=np.float64)

    def gradients(self, around: np.ndarray, number: np.ndarray, vocabulary: Vocabulary):
        """Of the mean negative log-probability: rows of ``near`` and their gradients, those of ``bias`` and of ``out``."""
        hidden, n = self.hidden(around), np.float32(len(number))
        error, total, own, _ = self.weighed(hidden, number, vocabulary)
        error *= (1 / (total * n))[:, None]
        error.ravel()[own] -= 1 / n
        error = error.reshape(len(number), -1)
        back = error @ self.out.T
        back *= hidden > 0
        # Only rows that stand around some word are touched.
        flat = around.ravel().astype(np.uint16 if len(self.near) < 1 << 16 else np.uint32)
        order = np.argsort(flat, kind="stable")
        at = flat[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        summed = np.add.reduceat(back[order % len(number)], first, axis=0)
        return at[first].astype(np.int64), summed, back.sum(axis=0), hidden.T @ error

    def step(self, around: np.ndarray, number: np.ndarray, vocabulary: Vocabulary) -> None:
        """One step of AdaGrad on a mini-batch."""
        rows, near, bias, out = self.gradients(around, number, vocabulary)
        squares = self.squares[0][rows] + near * near
        self.squares[0][rows] = squares
        self.near[rows] -= RATE * near / np.sqrt(squares)
        for weights, square, grad in ((self.bias, self.squares[1], bias), (self.out, self.squares[2], out)):
            square += grad * grad
            weights -= RATE * grad / np.sqrt(square)


def neighbours(classes: np.ndarray, row: np.ndarray, contexts: int) -> np.ndarray:
    """Rows of the embeddings at each place around each word; class ``contexts`` stands beyond the ends of a text."""
    n, out = len(classes), np.full((len(PLACES), len(classes)), contexts, dtype=np.int64)
    for i, k in enumerate(PLACES):
        here, there = (slice(k, n), slice(0, n - k)) if k > 0 else (slice(0, n + k), slice(-k, n))
        if n > abs(k):
            out[i, there] = np.where(row[here] == row[there], classes[here], contexts)
    return out + (np.arange(len(PLACES)) * (contexts + 1))[:, None]


def _prepared(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, row = buckets(texts, vocabulary.bits)
    number = vocabulary.number[found]
    return number, neighbours(vocabulary.context(number), row, vocabulary.contexts), row


def train(docs: DataFrame, vocabulary: Vocabulary) -> WindowNetwork:
    """One pass over all texts, by every partition from common weights, and the mean of what they have learnt."""
    network = WindowNetwork(vocabulary.contexts, vocabulary.digits)
    sent = docs.sparkSession.sparkContext.broadcast((network.vector, vocabulary))

    def local(batches):
        vector, known = sent.value
        net, seen, rng = WindowNetwork(known.contexts, known.digits, vector.copy()), 0, np.random.default_rng(SEED)
        for batch in batches:
            number, around, _ = _prepared(batch.column(0), known)
            order = rng.permutation(len(number))
            for a in range(0, len(order), BATCH):
                pick = order[a:a + BATCH]
                net.step(around[:, pick], number[pick], known)
            seen += len(number)
        return seen, net.vector * float(seen)

    total, seen = _summed(docs.select("text"), local, network.size)
    return WindowNetwork(vocabulary.contexts, vocabulary.digits, total / seen) if seen else network


def score_texts(texts: pa.Array, vocabulary: Vocabulary, network: WindowNetwork) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and summed log-probability of each text."""
    number, around, row = _prepared(texts, vocabulary)
    each = np.empty(len(number))
    for a in range(0, len(number), AT_ONCE):
        b = a + AT_ONCE
        each[a:b] = network.log_probability(around[:, a:b], number[a:b], vocabulary)
    return np.bincount(row, minlength=len(texts)), np.bincount(row, each, minlength=len(texts))


def pseudo_likelihood(docs: DataFrame, vocabulary: Vocabulary, network: WindowNetwork) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for every row of ``docs``."""
    sent, kind = docs.sparkSession.sparkContext.broadcast((vocabulary, network.vector)), docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        known, vector = sent.value
        n, total = score_texts(batch.column(1), known, WindowNetwork(known.contexts, known.digits, vector))
        return {"doc_id": batch.column(0), "n_tokens": n, "log_likelihood": total,
                "mean_log_likelihood": [t / m if m else None for t, m in zip(total.tolist(), n.tolist(), strict=True)]}

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, log_likelihood double, mean_log_likelihood double", run)


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How expected every document's words are, each from the words on both its sides."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = Vocabulary(bucket_counts(docs))
    return pseudo_likelihood(docs, vocabulary, train(docs, vocabulary))
