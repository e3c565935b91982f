"""Quality, language, likelihood and encoding of single texts."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailweave.llm import bpe_automaton, piece_language, pseudo_likelihood, pu_quality
from mailweave.llm.common import read

BIG = "/root/testdata/sf0.1"


def test_quality_of_held_out_documents(spark):
    scored = pu_quality.op1_pu_quality(spark, BIG).join(read(spark, BIG, "labels"), "doc_id").filter("held_out").toPandas()
    assert len(scored) > 500 and (scored.predicted == scored.quality).mean() > 0.97
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 1, 1), (8, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = pu_quality.quality_scores(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert not [r for r in rows if r.doc_id is None][0].held_out
    assert pu_quality.quality_scores(no_docs, labels).count() == 0
    assert {r.score for r in pu_quality.quality_scores(odd_docs, labels.filter("false")).collect()} == {0.5}
    assert pu_quality.keep_good(odd_docs, labels.filter("false")).columns == odd_docs.columns


def test_class_prior_and_non_negative_risk():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (4000, 5)), rng.normal(4, 1, (4000, 5))
    net, prior = pu_quality.learn(good[:2000], np.concatenate([good[2000:3400], bad[:600]]))
    assert abs(prior - 0.7) < 0.05
    assert (net.score(good[3400:]) > 0.3).mean() > 0.97 and (net.score(bad[2000:]) < 0.3).mean() > 0.97


def test_features_do_not_depend_on_neighbours():
    texts = ["a b a b", None, "", "X!! Y|\né 12"]
    together = pu_quality.features(pa.array(texts))
    alone = np.concatenate([pu_quality.features(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(together, alone) and not together[1].any() and not together[2].any()


def test_language_of_held_out_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    found = piece_language.op3_piece_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").toPandas()
    assert len(found) > 200 and (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = piece_language.fitted(odd_docs)
    rows = piece_language.predict(odd_docs, model).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert len(rows) == odd_docs.count() and und == {1, 2, 3} and all(r.score == 0 for r in rows if r.doc_id in und)
    assert set(model.languages) <= {"en", "de", "fr", "es"}
    assert piece_language.predict(no_docs, piece_language.fitted(no_docs)).count() == 0
    assert piece_language.predict(odd_docs, piece_language.fitted(no_docs)).select("lang_pred").distinct().collect()[0][0] == "und"


def _all_segmentations(model, k, marked):
    if not marked:
        return 1.0
    total = 0.0
    for n in range(1, len(marked) + 1):
        piece = model.ids.get(marked[:n], piece_language.UNKNOWN if n == 1 else None)
        if piece is not None:
            total += model.theta(k)[piece] * _all_segmentations(model, k, marked[n:])
    return total


def test_forward_algorithm_sums_all_segmentations():
    model = piece_language.PieceModel(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"], ["x", "y"])
    model.met = [(np.arange(9), row, 0.0) for row in np.random.default_rng(3).dirichlet(np.ones(9), 2)]
    words = ["a", "ab", "abba", "babab", "aqb", "ab" * 40]
    share = piece_language.FOREIGN
    for word, got in zip(words, model.word_scores(words), strict=True):
        if len(word) < 10:
            plain = np.array([_all_segmentations(model, k, "▁" + word) for k in range(2)])
            assert np.allclose(np.exp(got), (1 - share) * plain + share * plain.mean())
    # The long way and the short way agree.
    short = model.word_scores(["abbab" * 8])
    plain = np.exp(model._long("abbab" * 8))
    assert np.allclose(np.exp(short[0]), (1 - share) * plain + share * plain.mean())


def test_learning_long_words_like_short_ones(monkeypatch):
    pieces = piece_language.Pieces(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"])
    words, times = ["abba" * 10, "ab", "babab" * 7, "aqb"], np.array([3.0, 10.0, 2.0, 1.0])
    short = pieces.learnt(words, times)
    monkeypatch.setattr(piece_language, "LONG", 5)
    assert np.allclose(pieces.learnt(words, times), short) and abs(short.sum() - 1) < 1e-9
    very_long = "ab" * 4000
    uses = pieces.expected_long(very_long, short)
    assert np.isfinite(uses).all() and uses[piece_language.UNKNOWN] < 1e-9 and len(very_long) / 3 < uses.sum() <= len(very_long) + 1


def test_rare_and_long_words_and_stray_languages_count(spark):
    rows = [(i, " ".join(f"ordinary{chr(97 + j % 26)}" for j in range(40)), "en") for i in range(40)]
    rows += [(100 + i, "x" + "yz" * 40, "fr") for i in range(30)] + [(1000 + i, f"{'qwerty'[i % 6]}stray", f"stray{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = piece_language.fitted(docs)
    assert len(model.languages) > 150
    # A language of long words only has learnt them, and what a stray language has met is as small as its words.
    fr = model.languages.index("fr")
    assert len(model.met[fr][0]) and max(len(m[0]) for lang, m in zip(model.languages, model.met, strict=True) if lang.startswith("stray")) < 60
    found = {r.doc_id: r.lang_pred for r in piece_language.predict(docs, model).filter("held_out").collect()}
    held = [i for i in found if i < 1000]
    assert held and all(found[i] == ("en" if i < 100 else "fr") for i in held)


def _random_network(vocabulary, seed=5):
    net = pseudo_likelihood.WindowNetwork(vocabulary.contexts, vocabulary.digits)
    return pseudo_likelihood.WindowNetwork(vocabulary.contexts, vocabulary.digits, np.random.default_rng(seed).standard_normal(net.size) * 0.2)


def _plain_log_probability(net, vocabulary, counts, around, number):
    """Digit by digit, from the counts of all words whose numbers begin alike."""
    ranked, base = np.sort(counts)[::-1] + 1.0, pseudo_likelihood.BASE
    hidden = np.maximum(sum(net.near[r].astype(float) for r in around) + net.bias, 0)
    shift, total = hidden @ net.out.astype(float), 0.0
    for d in range(vocabulary.digits):
        below = base ** (vocabulary.digits - 1 - d)
        prefix, digit = number // below // base, number // below % base
        logits = np.full(base, -np.inf)
        for c in range(base):
            share = ranked[(prefix * base + c) * below:(prefix * base + c + 1) * below].sum()
            logits[c] = np.log(share) + shift[d * base + c] if share else -np.inf
        total += logits[digit] - np.log(np.exp(logits).sum())
    return total


def test_pseudo_likelihood_against_plain_sums(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b", "b", None, "", "c c c  d\nA b"])], "doc_id long, text string")
    counts = pseudo_likelihood.bucket_counts(docs)
    vocabulary = pseudo_likelihood.Vocabulary(counts)
    net = _random_network(vocabulary)
    got = {r.doc_id: r for r in pseudo_likelihood.pseudo_likelihood(docs, vocabulary, net).collect()}
    for r in docs.collect():
        found = pseudo_likelihood.buckets(pa.array([r.text], pa.string()), vocabulary.bits)[0]
        numbers, total = vocabulary.number[found].tolist(), 0.0
        for i, n in enumerate(numbers):
            around = []
            for p, k in enumerate(pseudo_likelihood.PLACES):
                inside = 0 <= i + k < len(numbers)
                around.append(p * (vocabulary.contexts + 1) + (int(vocabulary.context(np.array(numbers[i + k]))) if inside else vocabulary.contexts))
            total += _plain_log_probability(net, vocabulary, counts, around, n)
        assert got[r.doc_id].n_tokens == len(found) and abs(got[r.doc_id].log_likelihood - total) < 1e-3
        assert (got[r.doc_id].mean_log_likelihood is None) == (not len(found))


def test_an_untrained_network_gives_corpus_shares():
    counts = np.random.default_rng(3).integers(0, 50, 1 << 13)
    vocabulary = pseudo_likelihood.Vocabulary(counts)
    net = pseudo_likelihood.WindowNetwork(vocabulary.contexts, vocabulary.digits)
    number = np.arange(1 << 13)
    each = net.log_probability(np.zeros((len(pseudo_likelihood.PLACES), 1 << 13), dtype=np.int64), number, vocabulary)
    assert np.allclose(np.exp(each), (np.sort(counts)[::-1] + 1) / (counts.sum() + (1 << 13)), rtol=1e-4) and abs(np.exp(each).sum() - 1) < 1e-4


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    vocabulary = pseudo_likelihood.Vocabulary(rng.integers(0, 30, 1 << 12))
    net, n = _random_network(vocabulary), 40
    net.bias[:] = np.where(np.arange(pseudo_likelihood.HIDDEN) % 3, 3, -3)
    around = rng.integers(0, vocabulary.contexts + 1, (len(pseudo_likelihood.PLACES), n)) % 7 + (np.arange(len(pseudo_likelihood.PLACES)) * (vocabulary.contexts + 1))[:, None]
    number = rng.integers(0, 1 << 12, n)
    rows, near, bias, out = net.gradients(around, number, vocabulary)
    whole = np.zeros_like(net.near)
    whole[rows] = near
    grad = np.concatenate([whole.ravel(), bias.ravel(), out.ravel()])
    # Every bias and a choice of the touched embeddings and output weights.
    touched = (rows[:, None] * pseudo_likelihood.HIDDEN + np.arange(pseudo_likelihood.HIDDEN)).ravel()
    picked = np.concatenate([rng.choice(touched, 60), whole.size + np.arange(bias.size), whole.size + bias.size + rng.choice(out.size, 60)])
    # The rectifier has kinks: biases keep every unit away from them.
    loss = lambda v: -pseudo_likelihood.WindowNetwork(vocabulary.contexts, vocabulary.digits, v).log_probability(around, number, vocabulary).mean()
    for i in picked.tolist():
        step = np.zeros(net.size)
        step[i] = 3e-3
        difference = (loss(net.vector + step) - loss(net.vector - step)) / 6e-3
        assert abs(difference - grad[i]) < 2e-3 + 0.05 * abs(grad[i]), i


def test_the_vocabulary_grows_with_the_corpus(spark):
    sizes = []
    for n in (2_000, 60_000):
        docs = spark.range(n).select(F.concat_ws(" ", F.lit("the"), F.concat(F.lit("w"), "id"), F.concat(F.lit("v"), F.col("id") % 50)).alias("text"))
        counts = pseudo_likelihood.bucket_counts(docs)
        vocabulary = pseudo_likelihood.Vocabulary(counts)
        assert counts.sum() == 3 * n and len(counts) >= n
        sizes.append((vocabulary.bits, vocabulary.contexts))
    assert sizes[1][0] > sizes[0][0] and sizes[1][1] > sizes[0][1]


def test_training_makes_texts_more_likely(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    counts = pseudo_likelihood.bucket_counts(docs)
    plain = docs.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert counts.sum() == plain
    # A word that follows from its neighbours, in texts that training has not seen.
    rows = [(i, " ".join(f"left{i % 5} middle{i % 5} right{i % 5} noise{(7 * i + j) % 90}" for j in range(20))) for i in range(400)]
    seen, other = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows[:300], rows[300:]))
    vocabulary = pseudo_likelihood.Vocabulary(pseudo_likelihood.bucket_counts(seen))
    total = lambda net: pseudo_likelihood.pseudo_likelihood(other, vocabulary, net).agg(F.sum("log_likelihood")).first()[0]
    assert total(pseudo_likelihood.train(seen.coalesce(2), vocabulary)) > total(pseudo_likelihood.WindowNetwork(vocabulary.contexts, vocabulary.digits)) * 0.75


def test_likelihood_of_odd_rows(spark, odd_docs, no_docs):
    vocabulary = pseudo_likelihood.Vocabulary(pseudo_likelihood.bucket_counts(odd_docs))
    net = pseudo_likelihood.train(odd_docs, vocabulary)
    rows = pseudo_likelihood.pseudo_likelihood(odd_docs, vocabulary, net).collect()
    assert len(rows) == odd_docs.count() and {r.doc_id for r in rows if r.n_tokens == 0} == {1, 2, 3}
    assert max(r.n_tokens for r in rows) == 40_000 and all(r.log_likelihood <= 0 for r in rows)
    nothing = pseudo_likelihood.Vocabulary(pseudo_likelihood.bucket_counts(no_docs))
    assert pseudo_likelihood.pseudo_likelihood(no_docs, nothing, pseudo_likelihood.train(no_docs, nothing)).count() == 0


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_encoding_equals_the_library(spark, odd_docs, no_docs):
    file, library = bpe_automaton.tokenizer_file(), _library()
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    ids = bpe_automaton.encode(docs.filter("doc_id is not null"), file)
    texts = sorted((r.doc_id, r.text or "") for r in docs.filter("doc_id is not null").collect())
    want = sorted((i, e.ids, library.decode(e.ids, skip_special_tokens=False))
                  for (i, _), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True))
    got = sorted((r.doc_id, list(r.ids)) for r in ids.collect())
    assert got == [(i, e) for i, e, _ in want]
    assert sorted((r.doc_id, r.text) for r in bpe_automaton.decode(ids, file).collect()) == sorted((i, t) for i, _, t in want)
    assert bpe_automaton.digests(no_docs, file).count() == 0
    assert bpe_automaton.digests(odd_docs, file).count() == odd_docs.count()


def test_automaton_on_generated_texts():
    import random

    made, library, rng = bpe_automaton.Codec(bpe_automaton.tokenizer_file()), _library(), random.Random(5)
    signs = "ab cdeE'stΣσÉé́ß\x1c\x1f\x85\t\n <|>endoftext0½²_中文😀İıſK 　"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, "haha" * 9, "<|endoftext|><|STARTOFTEXT|>"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert made.encode(text) == want.ids


def test_automaton_equals_merging():
    """A small vocabulary, all words: the automaton's path is what merging in order gives."""
    import itertools

    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("ab", "a"), ("aa", "aa"), ("b", "b</w>"), ("a", "b</w>"), ("aa", "b</w>")]
    tokens = list(dict.fromkeys(["a", "b", "a</w>", "b</w>"] + [u + v for u, v in merges]))
    automaton = bpe_automaton.MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)

    def merged(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for u, v in merges:
            i, out = 0, []
            while i < len(parts):
                if parts[i:i + 2] == [u, v]:
                    out.append(u + v)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    for n in range(1, 10):
        for word in map("".join, itertools.product("ab", repeat=n)):
            assert [tokens[i] for i in automaton.encode(word)] == merged(word)


def test_network_trains_on_every_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(5000)], "doc_id long, text string")
    vocabulary = pseudo_likelihood.Vocabulary(pseudo_likelihood.bucket_counts(docs))
    seen, summed = [], pseudo_likelihood._summed
    monkeypatch.setattr(pseudo_likelihood, "_summed", lambda *given: (lambda made: seen.append(made[1]) or made)(summed(*given)))
    pseudo_likelihood.train(docs, vocabulary, rounds=1)
    assert seen == [20_000]


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(piece_language, "vocabulary", lambda path=None: ["▁", "a", "b", "▁ab"])
    docs = spark.createDataFrame([(i, f"l{i % 300}", "ab ba") for i in range(1800)], "doc_id long, lang string, text string")
    assert len(piece_language.fitted(docs).languages) == 300
