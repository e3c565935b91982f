"""Text quality from trusted positives and unlabelled text: non-negative positive-unlabelled learning.

Texts are described by what they are made of: shares of byte-class pairs, and figures on words, repeats and lines.  A first network tells
positives from unlabelled text; the class prior is the least ratio, over its score thresholds, of unlabelled to positive texts above
the threshold (best bin estimation), and is estimated anew from classifiers fitted with it.  The classifier proper minimises the unbiased risk
``prior R+(positives) + max(0, R-(unlabelled) - prior R-(positives))`` by mini-batches; where the second part turns
negative its gradient is reversed.  The score is the sigmoid of the network's output.

Learning takes at most ``POSITIVES`` and ``UNLABELLED`` texts, drawn by a hash of their ids; every text is scored, whole and in place.

Cases: null, empty and blank texts are scored like any other, from figures that are all zero; a label counts if its ``quality`` is 1 and is
found by ``doc_id``, once however often it is repeated; rows that repeat a ``doc_id`` are scored each; rows with a null ``doc_id``
are scored, never learnt from and not held out; without positives or unlabelled texts the score is the prior, 0.5; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import fold, map_batches, read, small_batches, thrifty
from mailweave.llm.shingles import words

POSITIVES = 8_000  # bound of the sample of trusted positives
UNLABELLED = 16_000  # bound of the sample of unlabelled texts
THRESHOLD = 0.3
HIDDEN = 24
STEPS = 2000
ROUNDS = 2  # times the prior is estimated anew from classifiers that used the last estimate
BATCH = 512
SEED = 5

# Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence marks, 6 quotes and brackets, 7 bars, 8 cries, 9 symbols,
# 10 link marks, 11 first bytes of other letters, 12 their following bytes, 13 control bytes.
KINDS = 14
KIND = np.full(256, 13, dtype=np.int64)
KIND[97:123], KIND[65:91], KIND[48:58] = 0, 1, 2
for _kind, _marks in ((3, b" \t\r\x0b\x0c"), (4, b"\n"), (5, b".,;:-"), (6, b"'\"()[]{}<>`"), (7, b"|"), (8, b"!?"), (9, b"#$%&*+=^~\\"), (10, b"/@_")):
    KIND[list(_marks)] = _kind
KIND[192:256], KIND[128:192] = 11, 12
FEATURES = KINDS * KINDS + 8


def features(texts: pa.Array) -> np.ndarray:
    """One row of figures a text."""
    n = len(texts)
    out = np.zeros((n, FEATURES))
    texts = pa.concat_arrays([texts.fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[:n + 1].astype(np.int64)
    size = np.diff(offsets)
    if not size.sum():
        return out
    kind = KIND[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]]
    row = np.repeat(np.arange(n), size)
    pair = kind[:-1] * KINDS + kind[1:]
    inside = row[:-1] == row[1:]
    counts = np.bincount((row[:-1] * (KINDS * KINDS) + pair)[inside], minlength=n * KINDS * KINDS).reshape(n, -1)
    out[:, :KINDS * KINDS] = np.sqrt(counts / np.maximum(size - 1, 1)[:, None])
    hashed, of = words(texts)
    many = np.bincount(of, minlength=n)
    if len(hashed):
        different = np.bincount(_distinct(of, hashed), minlength=n)
        again = np.bincount(of[1:][(of[1:] == of[:-1]) & (hashed[1:] == hashed[:-1])], minlength=n)
        filled = np.maximum(many, 1)
        out[:, -8] = again / filled
        out[:, -7] = different / filled
        out[:, -6] = different / filled ** 0.8
        out[:, -5] = np.log1p((size - many) / filled)
    lines = np.bincount(row[kind == 4], minlength=n) + 1
    out[:, -4] = np.log1p(many / lines)
    out[:, -3] = np.log1p(many)
    out[:, -2] = np.log1p(lines)
    out[:, -1] = 1
    out[size == 0] = 0
    return out


def _distinct(of: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The row of each word that is met in the row for the first time."""
    order = np.lexsort((hashed, of))
    a, b = of[order], hashed[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return a[first]


class Network:
    """One hidden layer over standardised figures."""

    def __init__(self, inputs: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = inputs.mean(axis=0), inputs.std(axis=0) + 1e-3
        d = inputs.shape[1]
        self.weights = [rng.standard_normal((d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        self._first = [np.zeros_like(w) for w in self.weights]
        self._second = [np.zeros_like(w) for w in self.weights]
        self._steps = 0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5).astype(np.float32)

    def forward(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        hidden = np.tanh(z @ a + b)
        return hidden @ c + d, hidden

    def step(self, z: np.ndarray, hidden: np.ndarray, slope: np.ndarray, rate: float, decay: float = 1e-4) -> None:
        """One Adam step, ``slope`` being the derivative of the risk by each output."""
        a, _, c, _ = self.weights
        back = np.outer(slope, c) * (1 - hidden ** 2)
        self._steps += 1
        for i, g in enumerate((z.T @ back + decay * a, back.sum(axis=0), hidden.T @ slope + decay * c, np.array([slope.sum()]))):
            self._first[i] = 0.9 * self._first[i] + 0.1 * g
            self._second[i] = 0.999 * self._second[i] + 0.001 * g ** 2
            bias = np.sqrt(1 - 0.999 ** self._steps) / (1 - 0.9 ** self._steps)
            self.weights[i] = self.weights[i] - rate * bias * self._first[i] / (np.sqrt(self._second[i]) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(self.standard(x))[0], -500, 500)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best bin estimation from scores of texts that the scoring network has not learnt from."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 89))
    of_p = np.array([(positive >= c).mean() for c in cuts])
    of_u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = np.argmin((of_u + slack) / of_p)
    return float(np.clip(of_u[best] / of_p[best], 0.01, 0.99))


def _batches(seed: int, p: int, u: int, steps: int):
    """Index pairs of ``steps`` mini-batches that go through both samples in random order, again and again, and learning rates."""
    rng = np.random.default_rng(seed)
    each = max(1, -(-max(p, u) // BATCH))
    for step in range(steps):
        if step % each == 0:
            of_p = np.array_split(rng.permutation(np.resize(np.arange(p), max(p, each))), each)
            of_u = np.array_split(rng.permutation(np.resize(np.arange(u), max(u, each))), each)
        yield of_p[step % each], of_u[step % each], 0.01 * (1 - step / steps)


def fit_plain(positive: np.ndarray, unlabelled: np.ndarray, steps: int = STEPS // 5) -> Network:
    """Positives against unlabelled texts, as if these were negative."""
    net = Network(np.concatenate([positive, unlabelled]))
    zp, zu = net.standard(positive), net.standard(unlabelled)
    for i, j, rate in _batches(SEED, len(zp), len(zu), steps):
        z = np.concatenate([zp[i], zu[j]])
        out, hidden = net.forward(z)
        net.step(z, hidden, np.r_[-_sigmoid(-out[:len(i)]) / len(i), _sigmoid(out[len(i):]) / len(j)] / 2, rate)
    return net


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> Network:
    """Minimise the non-negative risk with the logistic loss."""
    net = Network(unlabelled)
    zp, zu = net.standard(positive), net.standard(unlabelled)
    for i, j, rate in _batches(SEED + 1, len(zp), len(zu), steps):
        z = np.concatenate([zp[i], zu[j]])
        out, hidden = net.forward(z)
        p, u = out[:len(i)], out[len(i):]
        if np.logaddexp(0, u).mean() >= prior * np.logaddexp(0, p).mean():
            slope = np.r_[prior * (-_sigmoid(-p) - _sigmoid(p)) / len(i), _sigmoid(u) / len(j)]
        else:
            slope = np.r_[prior * _sigmoid(p) / len(i), -_sigmoid(u) / len(j)]
        net.step(z, hidden, slope, rate)
    return net


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[Network | None, float]:
    """The classifier and the class prior it was given.  Halves of the samples estimate the prior crosswise."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return None, 0.5
    halves = ((slice(0, None, 2), slice(1, None, 2)), (slice(1, None, 2), slice(0, None, 2)))

    def estimated(fit) -> float:
        nets = [(fit(positive[own], unlabelled[own]), other) for own, other in halves]
        return float(np.mean([class_prior(net.score(positive[other]), net.score(unlabelled[other])) for net, other in nets]))

    prior = estimated(fit_plain)
    for _ in range(ROUNDS):
        prior = estimated(lambda p, u, prior=prior: fit_nnpu(p, u, prior, STEPS // 2))
    return fit_nnpu(positive, unlabelled, prior), prior


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = 5, positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """Figures of the two samples: texts with the least hashes of their ids.

    The list of ids is bounded by the two limits, so it may be sent to every task, and texts do not move.
    """

    def drawn(rows: DataFrame, seed: int, limit: int) -> DataFrame:
        ids = rows.filter(fold(F.col("doc_id"), folds) != 0).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(limit)

    chosen = drawn(labels.filter("quality = 1"), SEED, positives).select("doc_id", F.lit(True).alias("positive")).unionByName(
        drawn(docs, SEED + 1, unlabelled).select("doc_id", F.lit(False).alias("positive")))
    chosen = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"), (~F.min("positive")).alias("unlabelled"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batch):
        return {"doc_id": batch.column(0), "positive": batch.column(2), "unlabelled": batch.column(3),
                "figures": [f.tobytes() for f in features(batch.column(1)).astype(np.float32)]}

    found = map_batches(rows.select("doc_id", "text", "positive", "unlabelled"),
                        "doc_id long, positive boolean, unlabelled boolean, figures binary", run).collect()
    found.sort(key=lambda r: (r.doc_id, r.figures))
    as_matrix = lambda rows: np.array([np.frombuffer(r.figures, dtype=np.float32) for r in rows], dtype=np.float32).reshape(-1, FEATURES)
    return as_matrix([r for r in found if r.positive]), as_matrix([r for r in found if r.unlabelled])


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, **bounds: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; labels of fold 0 are never learnt from."""
    net, prior = learn(*training_sample(docs, labels, folds, **bounds))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        if net is None:
            score = np.full(batch.num_rows, prior)
        else:
            score = net.score(features(batch.column(2)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False)).alias("held_out")
    return map_batches(docs.select("doc_id", held, "text"), f"doc_id {kind}, held_out boolean, score double, predicted int", run)


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, **bounds: int) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, with all their columns; texts are filtered where they lie."""
    net, prior = learn(*training_sample(docs, labels, folds, **bounds))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows and (net is not None or prior >= THRESHOLD):
                yield batch if net is None else batch.filter(pa.array(net.score(features(batch.column(at))) >= THRESHOLD))

    # Plain names meanwhile: the map takes none with dots.
    plain = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*plain)
    return small_batches(renamed).mapInArrow(thrifty(run), renamed.schema).toDF(*docs.columns)


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from positives and unlabelled texts outside the held-out fold."""
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
