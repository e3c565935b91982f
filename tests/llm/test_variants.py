"""Spelling variants against brute force, odd rows, and signatures with very many words."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from mailweave.llm import spelling_variants as S


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and edits(v, w) == 1] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def result(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def counts():
    rng = random.Random(3)
    words = {"".join(rng.choice("abeéñt") for _ in range(rng.randint(5, 8))) for _ in range(350)}
    for w in list(words)[:120]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + "x" + w[i:], w[:i] + "ÿ" + w[i + 1:]}
    long = "langes" * 30
    words |= {long, long + "s", long[:90] + "x" + long[91:], long[:90] + long[92:]}
    return {w: rng.choice([3, 4, 6, 8, 16, 40, 100]) for w in sorted(words) if len(w) >= 5}


def _words(spark, counts):
    return spark.createDataFrame([(w, n, "x", 1) for w, n in counts.items()], "word string, n long, best string, signature int").select("word", "n")


def test_against_brute_force(spark, counts):
    want = brute(counts)
    assert result(S.variants(_words(spark, counts))) == want
    assert any(r is not None and want[r][0] is not None for r, *_ in want.values())  # chains of forms


def test_signatures_with_many_words(spark, counts):
    words = _words(spark, counts)
    want = {w: x[3] for w, x in brute(counts).items() if x[3]}
    for hot, chunk in ((4, 64), (2, 3), (10, 1000)):
        got = S.near_words(words, hot=hot, chunk=chunk).collect()
        assert {r.word: r.n_near for r in got} == want and len(got) == len(want)


def test_near_words_share_a_signature():
    rng = random.Random(8)
    groups = {ord(c): i % S.GROUPS for i, c in enumerate("etaoinshrdlu")}
    for _ in range(400):
        a = "".join(rng.choice("etaoinshrdluéß") for _ in range(rng.randint(1, 12)))
        i, c = rng.randrange(len(a)), rng.choice("etaoinx")
        for b in (a[:i] + c + a[i:], a[:i] + c + a[i + 1:], a[:i] + a[i + 1:]):
            if a == b or not b:
                continue
            one, two = S.Vectors([a, b], groups).signatures()
            same = np.flatnonzero(one == two)
            assert len(same) and ((same < S.PAIRS) == (len(a) == len(b))).any() and S.one_edit(a, b) and edits(a, b) == 1


def test_one_edit():
    letters = ["".join(t) for n in range(4) for t in itertools.product("ab", repeat=n)]
    assert all(S.one_edit(a, b) == (edits(a, b) == 1) for a in letters for b in letters)


def test_vocabulary_of_odd_documents(spark, odd_docs, no_docs):
    want = Counter()
    for r in odd_docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
                at = h % len(run)
                want[run[:at] + run[at + 1:] if h % 97 == 0 else run] += 1
            run = ""
    got = {r.word: r.n for r in S.vocabulary(odd_docs, least_letters=4, least_count=2).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 4 and n >= 2} and got
    assert S.variants(S.vocabulary(no_docs)).count() == 0
    one = spark.createDataFrame([(1, "lonely lonely lonely")], "doc_id long, text string")
    assert result(S.variants(S.vocabulary(one, damage=1 << 40))) == {"lonely": (None, "lonely", 3, 0, None)}


def test_damaged_runs(spark):
    rows = [(i, "Schönheiten çédille abcdef") for i in range(400)] + [(None, "abcdef")]
    got = {r.word: r.n for r in S.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1).collect()}
    want = Counter()
    for i, text in rows:
        for run in text.lower().split():
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    assert got == dict(want) and len(got) > 3
