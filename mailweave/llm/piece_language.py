"""Language of a text from unigram probabilities of vocabulary pieces, summed over all segmentations.

A text is taken as its runs of letters, lower-cased.  For each language every piece of a fixed public vocabulary has a probability.
The probability of a word is the sum, over all ways to cut it into pieces, of the products of their probabilities (forward algorithm);
a text's is the product over its words, times the language's share of texts.  Piece probabilities are learnt by
expectation maximisation, also over all segmentations.  With a small chance a word is of any language, so a borrowed passage weighs
by its length and not by how strange its letters are.

Learning reads about ``DOCS`` texts a language, drawn by a hash of their ids, and all their words, whatever their length or number; each
language learns in a task of its own and gives back the pieces it has met, so a table with very many languages costs what their words
cost.  Every text is scored, whole and in place.  A letter outside the vocabulary counts as one unknown piece.

Cases: a text that is null or has no letter is ``und`` with score 0; without anything to learn from every text is ``und``; rows with
a null ``doc_id`` or ``lang`` are scored and never learnt from, and a null id is not held out; ties go to the language that sorts first;
rows that repeat a ``doc_id`` are scored each; words of any length are summed whole; an empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import fold, map_batches, read

DOCS = 1000  # texts a language to learn from, about
ROUNDS = 5
FOREIGN = 0.3  # chance that a word of a text is of any language
PSEUDO = 0.05  # count given to every piece in every language
LONG = 64  # letters above which a word is summed step by step, with rescaling
LEARN_AT_ONCE = 20_000  # words whose arcs are held together while learning
TOGETHER = 8  # languages whose sums are held together
CACHE = 500_000  # words a worker remembers; emptied when full
START = "▁"  # how the vocabulary marks the start of a word
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = 0


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) else []


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces that can stand in a lower-cased word; the file's path is a parameter."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    plain = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (
        model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return [p for p in plain if p.lower() == p and (p == START or p.removeprefix(START).isalpha())]


class Pieces:
    """A vocabulary and the segmentations it allows; piece 0 is the unknown letter."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.ids = {p: i + 1 for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        # Every beginning of a piece, with -1 where it is no piece itself: a look-up that fails ends the search at its place.
        self.starts = {p[:n]: -1 for p in pieces for n in range(1, len(p) + 1)} | self.ids

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every piece at every place: word number, start, end, piece.  Words are shorter than 127 letters, pieces than 64."""
        packed = []
        add, find = packed.append, self.starts.get
        for w, word in enumerate(words):
            marked = START + word
            n = len(marked)
            for i in range(n):
                at = (w << 7 | i) << 6
                j, p = i + 1, find(marked[i])
                if p is None or p < 0:
                    add((at | 1) << 20 | UNKNOWN)
                while p is not None:
                    if p > 0:
                        add((at | j - i) << 20 | p)
                    j += 1
                    if j > n:
                        break
                    p = find(marked[i:j])
        packed = np.array(packed, dtype=np.int64)
        start = packed >> 26 & 127
        return packed >> 33, start, start + (packed >> 20 & 63), packed & (1 << 20) - 1

    def forward(self, n: int, arcs, thetas: list[np.ndarray], width: int) -> np.ndarray:
        """``alpha[k, w, e]``: probability of the first e letters in language k, all segmentations."""
        of, start, end, piece = arcs
        alpha = np.zeros((len(thetas), n, width + 1))
        alpha[:, :, 0] = 1
        # The order of the arcs is the same in all languages.
        order = np.argsort(end.astype(np.int16), kind="stable")
        cuts = np.searchsorted(end[order], np.arange(width + 2))
        of, start, piece = of[order], start[order], piece[order]
        for e in range(1, width + 1):
            at = slice(cuts[e], cuts[e + 1])
            words, here, used = of[at], start[at], piece[at]
            for k, theta in enumerate(thetas):
                alpha[k, :, e] = np.bincount(words, alpha[k][words, here] * theta[used], minlength=n)
        return alpha

    def long_arcs(self, word: str) -> list[list[tuple[int, int]]]:
        """For every end in a long word the (start, piece) of all arcs."""
        marked = START + word
        found = []
        for e in range(1, len(marked) + 1):
            here = [(e - 1, self.ids.get(marked[e - 1], UNKNOWN))]
            here += [(e - n, p) for n in range(2, min(self.longest, e) + 1) if (p := self.ids.get(marked[e - n:e])) is not None]
            found.append(here)
        return found

    def expected_long(self, word: str, theta: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in a long word; forward and backward sums are rescaled at every place."""
        arcs = self.long_arcs(word)
        n = len(arcs)
        alpha, scale = np.zeros(n + 1), np.ones(n + 1)
        alpha[0] = 1
        for e, here in enumerate(arcs, 1):
            # alpha[i] stands for itself times the product of scale[1..i].
            total, factor, at = 0.0, 1.0, e - 1
            for i, p in here:
                while at > i:
                    factor, at = factor / scale[at], at - 1
                total += alpha[i] * factor * theta[p]
            scale[e], alpha[e] = total, 1.0
        expected, beta = np.zeros(len(theta)), np.zeros(n + 1)
        beta[n] = 1
        for e in range(n, 0, -1):
            factor, at = 1.0 / scale[e], e - 1
            for i, p in arcs[e - 1]:
                while at > i:
                    factor, at = factor / scale[at], at - 1
                share = alpha[i] * theta[p] * factor * beta[e]
                expected[p] += share
                beta[i] += share
        return expected

    def learnt(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Piece probabilities of one language by expectation maximisation over its word counts."""
        theta = np.full(len(self.pieces) + 1, 1.0 / (len(self.pieces) + 1))
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        long = [(words[i], times[i]) for i in sorted(set(range(len(words))) - set(short))]
        blocks = []
        for a in range(0, len(short), LEARN_AT_ONCE):
            kept = [words[i] for i in short[a:a + LEARN_AT_ONCE]]
            blocks.append((self.arcs(kept), np.array([len(w) + 1 for w in kept], dtype=np.int64), times[short[a:a + LEARN_AT_ONCE]]))
        for _ in range(ROUNDS if words else 0):
            expected = np.full(len(theta), PSEUDO)
            for arcs, last, n in blocks:
                of, start, end, piece = arcs
                weight, width = theta[piece], int(end.max(initial=0))
                alpha, = self.forward(len(last), arcs, [theta], width)
                # Backwards is forwards on mirrored arcs.
                beta, = self.forward(len(last), (of, last[of] - end, last[of] - start, piece), [theta], width)
                whole = alpha[np.arange(len(last)), last]
                share = alpha[of, start] * weight * beta[of, last[of] - end] / whole[of] * n[of]
                expected += np.bincount(piece, share, minlength=len(theta))
            for word, n in long:
                expected += n * self.expected_long(word, theta)
            theta = expected / expected.sum()
        return theta


class PieceModel(Pieces):
    """For each language the pieces that it has met, their probabilities, and the one probability of all others."""

    def __init__(self, pieces: list[str], languages: list[str]):
        super().__init__(pieces)
        none = np.zeros(0, dtype=np.int32), np.zeros(0), 1.0 / (len(pieces) + 1)
        self.languages, self.met = languages, [none] * len(languages)
        self.prior = np.zeros(len(languages))
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def theta(self, k: int) -> np.ndarray:
        at, value, rest = self.met[k]
        out = np.full(len(self.pieces) + 1, rest)
        out[at] = value
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        out = np.empty((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) < LONG]
        if short:
            chosen = [words[i] for i in short]
            arcs = self.arcs(chosen)
            width, last = int(arcs[2].max()), np.array([len(w) + 1 for w in chosen])
            for a in range(0, len(self.languages), TOGETHER):
                alpha = self.forward(len(chosen), arcs, [self.theta(k) for k in range(len(self.languages))[a:a + TOGETHER]], width)
                out[short, a:a + TOGETHER] = np.log(alpha[:, np.arange(len(chosen)), last]).T
        for i in set(range(len(words))) - set(short):
            out[i] = self._long(words[i])
        # Any word may be a foreign one: a few words of another language cannot outweigh the rest.
        foreign = np.logaddexp.reduce(out, axis=1, keepdims=True) - np.log(len(self.languages))
        return np.logaddexp(np.log(1 - FOREIGN) + out, np.log(FOREIGN) + foreign)

    def _long(self, word: str) -> np.ndarray:
        arcs, scale = self.long_arcs(word), np.zeros(len(self.languages))
        used = sorted({p for here in arcs for _, p in here})
        place = {p: i for i, p in enumerate(used)}
        theta = np.stack([self.theta(k)[used] for k in range(len(self.languages))], axis=1)  # pieces of the word x languages
        behind = [np.ones(len(self.languages))]  # alpha of the last places, divided by exp(scale)
        for e, here in enumerate(arcs, 1):
            total = sum(behind[i - e] * theta[place[p]] for i, p in here)
            behind = [*behind[-self.longest + 1:], total] if self.longest > 1 else [total]
            if e % 32 == 0:
                top = np.max(behind, axis=0)
                behind, scale = [b / top for b in behind], scale + np.log(top)
        return np.log(behind[-1]) + scale

    def forget(self) -> None:
        self.known.clear()
        self.rows = []

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t) for t in texts]
        known = self.known
        if len(known) > CACHE:
            self.forget()
        fresh = list(dict.fromkeys(w for words in found for w in words if w not in known))
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            self.rows.append(self.word_scores(fresh))
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)] if len(self.rows) > 64 or fresh else self.rows
        table = self.rows[0] if self.rows else np.zeros((0, len(self.languages)))
        names, scores = [], []
        for words in found:
            if not words or not self.languages:
                names.append("und")
                scores.append(0.0)
                continue
            total = table[[known[w] for w in words]].sum(axis=0) + self.prior
            best = int(np.argmax(total))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def word_counts(docs: DataFrame, shares: DataFrame, docs_each: int) -> DataFrame:
    """(lang, word, n): counts of all words of the sampled texts of each language; ``shares``: (lang, n), its texts."""
    place = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30))
    # One row a language; texts stay where they are.
    drawn = docs.join(F.broadcast(shares), "lang").filter(place < F.least(F.lit(1.0), F.lit(float(docs_each)) / F.col("n")) * (1 << 30))

    def run(batch):
        counts = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, w) for w in words_of(text))
        return {"lang": [k[0] for k in counts], "word": [k[1] for k in counts], "n": list(counts.values())}

    counted = map_batches(drawn.select("lang", "text"), "lang string, word string, n long", run)
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learnt_pieces(counts: DataFrame, pieces: list[str]) -> DataFrame:
    """(lang, piece, theta, rest): each language learns in its own group, of the words of about ``DOCS`` texts, and gives back what it has met."""
    sent = counts.sparkSession.sparkContext.broadcast(pieces)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("word")
        theta = Pieces(sent.value).learnt(rows["word"].tolist(), rows["n"].to_numpy(dtype=np.float64))
        rest = float(theta.min())
        met = np.flatnonzero(theta > rest * (1 + 1e-9))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "piece": [met.astype(np.int32)], "theta": [theta[met]], "rest": [rest]})

    return counts.groupBy("lang").applyInPandas(learn, "lang string, piece array<int>, theta array<double>, rest double")


def fitted(docs: DataFrame, folds: int = 3, docs_each: int = DOCS, path: str | None = None) -> PieceModel:
    """Learn from rows outside fold 1 that have an id and a language."""
    usable = docs.select("doc_id", "lang", "text").filter((fold(F.col("doc_id"), folds) != 1) & F.col("lang").isNotNull())
    shares = usable.groupBy("lang").agg(F.count("*").alias("n"))
    languages = {r["lang"]: r["n"] for r in shares.orderBy("lang").collect()}  # one row a language
    model = PieceModel(vocabulary(path), sorted(languages))
    if languages:
        total = np.array([languages[name] for name in model.languages], dtype=np.float64)
        model.prior = np.log(total / total.sum())
        place = {name: k for k, name in enumerate(model.languages)}
        for r in learnt_pieces(word_counts(usable, shares, docs_each), model.pieces).collect():
            model.met[place[r.lang]] = np.array(r.piece, dtype=np.int32), np.array(r.theta), r.rest
    return model


def predict(docs: DataFrame, model: PieceModel, folds: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``."""
    sent, kind = docs.sparkSession.sparkContext.broadcast(model), docs.schema["doc_id"].dataType.simpleString()

    def run(batch):
        names, scores = sent.value.score(batch.column(2).to_pylist())
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": names, "score": scores}

    held = F.coalesce(fold(F.col("doc_id"), folds) == 1, F.lit(False)).alias("held_out")
    return map_batches(docs.select("doc_id", held, "text"), f"doc_id {kind}, held_out boolean, lang_pred string, score double", run,
                       lambda: sent.value.forget())


def op3_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, fitted(docs))
