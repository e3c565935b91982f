"""Shingle join and source mix against brute force; archives; the whole pipeline."""

import io
import zipfile
from collections import defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mailweave.llm import bpe_automaton, ngram_join, pu_quality, source_mix, warc_zip
from mailweave.llm.common import read, write_scratch
from mailweave.llm.rows import told_apart, without
from mailweave.llm.shingles import shingles
from mailweave.session import scratch_path

from .test_lines import _plain


def plain_components(rows, k, percent):
    """All pairs, no filters."""
    sets, parent = {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.setdefault(i, []).append({tuple(words[n:n + k]) for n in range(max(1, len(words) - k + 1))} if words else set())
        parent[i] = i
    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_components_against_all_pairs(spark, k, percent):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs]
    for i, r in enumerate(docs[:40]):
        words = r.text.split(" ")
        for copy in range(4):  # chains of small changes
            for at in range(0, len(words), 60):
                words[at] = f"w{copy}"
            rows.append((1000 + 10 * i + copy, "  ".join(words).upper()))
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows, k, percent) and len(got) == len(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    got = ngram_join.similar_components(odd_docs, 4, 85).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect() if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == plain_components(rows, 4, 85)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(10, None)]
    assert {r.doc_id: r.n_shingles for r in got}[3] == 0 and len(got) == odd_docs.count()
    assert ngram_join.similar_components(no_docs, 4, 85).count() == 0
    kept = ngram_join.one_of_each_component(odd_docs, 4, 85)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 7, 8]


def test_blocks_give_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:60] + [f"x{i}"] + words[60:])) for i in range(20)]
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r.component_id for r in got} == {0}


def test_shingles_of_a_batch():
    texts = [" A b\tc d e", None, "", "a B", "a b c d e", "x" * 9000 + " y"]
    made, cuts = shingles(pa.array(texts), 4)
    sets = [set(made[i:j].tolist()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    assert [len(s) for s in sets] == [2, 0, 0, 1, 2, 1] and sets[0] == sets[4]
    alone = shingles(pa.array(texts).slice(3, 2), 4)
    assert set(alone[0][alone[1][1]:].tolist()) == sets[4]


def plain_shares(tree, budget):
    """``tree``: name -> (weight, capacity or subtree); exact water filling by repeated sharing."""
    capacity = lambda t: t if isinstance(t, int) else sum(capacity(c) for w, c in t.values() if w)
    if isinstance(tree, int):
        return budget
    open_, level = {n: (w, capacity(c)) for n, (w, c) in tree.items() if w}, budget
    given = dict.fromkeys(tree, 0)
    while open_:
        units = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * units <= level * w}
        if not full:
            floor = {n: level * w // units for n, (w, _) in open_.items()}
            spare = level - sum(floor.values())
            given |= {n: floor[n] + (i < spare) for i, n in enumerate(sorted(floor))}
            break
        # Smallest first, one at a time, so that later ones see the new level.
        name = min(full, key=lambda n: (Fraction(full[n], open_[n][0]), n))
        given[name] = full[name]
        level -= full[name]
        del open_[name]
    return {n: plain_shares(tree[n][1], given[n]) for n in tree}


def test_shares_meet_shortages_among_siblings_first(spark):
    leaves = [("v:a", "v:en", "v:1", 100), ("v:a", "v:en", "v:2", 5), ("v:a", "n", "v:3", 40), ("v:b", "v:en", "v:4", 7), ("v:c", "v:de", "v:5", 900),
              ("v:c", "v:zz", "v:6", 50), ("v:d", "v:en", "v:7", 0)]
    weights = {"domain": {"a": 3, "c": 2}, "lang": {"en": 2, "zz": 0}, "source": {"2": 7}}
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    w = lambda level, node: weights[level].get(node[2:], 1) if node != "n" else 1
    tree = defaultdict(lambda: defaultdict(dict))
    for d, lang, s, n in leaves:
        tree[d][lang][s] = (w("source", s), n)
    full = {d: (w("domain", d), {la: (w("lang", la), leaf) for la, leaf in langs.items()}) for d, langs in tree.items()}
    for budget in (0, 1, 10, 57, 200, 999, 5000):
        got = source_mix.leaf_budgets(df, weights, F.lit(budget), 1).collect()
        want = plain_shares(full, min(budget, 1052))
        assert {(r.domain, r.lang, r.source): r.share for r in got} == {(d, la, s): want[d][la][s] for d, la, s, _ in leaves}


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = source_mix.mix(odd_docs, F.col("source"), {}, F.expr("all * 3"), 3).collect()
    words = {(r.doc_id, r.text): len((r.text or "").split()) for r in odd_docs.collect()}
    assert sum(r.tokens for r in got) == 3 * sum(len((r.text or "").split()) for r in odd_docs.collect()) and words
    assert {r.epoch for r in got} == {0, 1, 2}
    assert source_mix.mix(no_docs, F.col("source"), {}, F.expr("all"), 1).count() == 0
    kept = source_mix.keep_mix(odd_docs, F.col("source"), {}, F.expr("all"))
    assert kept.columns == odd_docs.columns


def test_prefix_is_the_start_of_a_seeded_stream(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    few = source_mix.mix(docs, F.lit("d"), {}, F.lit(100), 1).collect()
    more = source_mix.mix(docs, F.lit("d"), {}, F.lit(300), 1).collect()
    assert sum(r.tokens for r in few) == 100 and sum(r.tokens for r in more) == 300
    assert {r.doc_id for r in few} <= {r.doc_id for r in more}
    assert {r.doc_id for r in source_mix.mix(docs, F.lit("d"), {}, F.lit(100), 1, seed=1).collect()} != {r.doc_id for r in few}


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    out = io.BytesIO()
    members = [("a", b"xy" * 1000), ("b/é", b""), ("c", b"\x00\xff")]
    size = warc_zip.write_zip(out, members, zip64)
    assert size == len(out.getvalue())
    with zipfile.ZipFile(out) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    found = warc_zip.central_directory(out, size)
    for name, data in members:
        out.seek(warc_zip.data_start(out, found[name]))
        assert out.read(found[name].size) == data


def test_foreign_zip_files_are_read():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05 a note"
        z.writestr("stored", b"123")
        z.writestr("packed", b"123" * 99, zipfile.ZIP_DEFLATED)
    assert set(warc_zip.central_directory(out, len(out.getvalue()))) == {"stored"}
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.central_directory(io.BytesIO(b"no zip"), 6)


def test_odd_pages_come_back(spark):
    big = "p" * 1500
    rows = [(1, "http://a/ b\r\nX: y", big, 0), (2, None, big, 1), (2, "http://c", big, 2), (3, "http://d", None, 3), (4, "http://e", "", 4), (5, "http://f", "é" * 499, 5),
            (6, "http://f", "é" * 499, 6), (None, "http://g", big, 7), (7, "u", "z\r\n\r\nWARC/1.1" * 9000, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    packages = warc_zip.write_packages(warc_zip.with_revisits(pages), scratch_path(spark, "wacz"), package_bytes=600, zip64=True)
    assert packages.count() > 1
    got = warc_zip.read_packages(packages, payload=True).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        [("1", "revisit", 2, 1500), ("2", "response", None, 1500), ("2", "response", None, 1500), ("3", "response", None, 0), ("4", "response", None, 0),
         ("5", "response", None, 998), ("6", "response", None, 998), ("None", "response", None, 1500), ("7", "response", None, 117000)])
    assert {bytes(r.payload) for r in got if r.page_id == 7} == {b"z\r\n\r\nWARC/1.1" * 9000}
    empty = warc_zip.write_packages(warc_zip.with_revisits(pages.filter("false")), scratch_path(spark, "wacz"))
    assert warc_zip.read_packages(empty).count() == 0


def test_pipeline_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "copies", "mix", "encode"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(write_scratch(stage(spark, frames[-1], sf), "pipeline-test"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    good, lines, copies, mixed, encoded = ([r for r in f.collect()] for f in frames[1:])
    scores = {r.doc_id: r.predicted for r in pu_quality.quality_scores(docs, read(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in good} == {i for i, p in scores.items() if p}
    assert sorted((r.doc_id, r.text) for r in lines) == [(i, t) for i, t, _, _ in sorted(_plain([(r.doc_id, r.text) for r in good]))]
    assert all(r.n_chars == len(r.text) for r in lines)
    parts = plain_components([(r.doc_id, r.text) for r in lines], 5, 80)
    assert {r.doc_id for r in copies} == {i for i, c in parts.items() if i == c}
    whole = sum(len(r.text.split()) for r in copies)
    assert {r.doc_id for r in mixed} < {r.doc_id for r in copies}
    assert sum(len(r.text.encode().split()) for r in mixed) >= 0.9 * whole
    made = bpe_automaton.Codec(bpe_automaton.tokenizer_file())
    assert {r.doc_id: r.n_tokens for r in encoded} == {r.doc_id: len(made.encode(r.text)) for r in mixed}
    assert corpus_pipeline.run(spark, sf).count() == len(encoded)


def test_rows_under_one_id_are_told_apart_by_text(spark):
    rows = [(1, f"text {i % 7}", "en", f"src{i}") for i in range(40)] + [(2, "alone", "en", "src1"), (3, "gone", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = source_mix.keep_mix(docs, F.lit("d"), {}, F.expr("all")).collect()
    assert sorted((r.doc_id, r.text) for r in mixed) == sorted({(i, t) for i, t, _, _ in rows})
    first, again = ([tuple(r) for r in without(*told_apart(docs.repartition(n)), docs.filter("doc_id = 3").select("doc_id")).orderBy("doc_id", "text").collect()]
                    for n in (1, 13))
    assert first == again == [*((1, f"text {i}", "en", f"src{min(range(i, 40, 7), key=str)}") for i in range(7)), (2, "alone", "en", "src1")]


def test_copies_among_rows_that_share_an_id(spark):
    long = [" ".join(f"w{(i * j) % 97}x{i}" for j in range(80)) for i in range(6)]
    rows = [(5, long[0], "a"), (5, long[1], "b"), (3, long[1] + " more", "c"), (None, long[0], "d"), (None, long[2], "e"), (None, long[2] + " end", "f"),
            (9, long[3], "g"), (9, long[3], "h"), (9, long[3] + " x", "i"), (4, long[4], "j"), (6, long[4], "k"), (7, "", "l"), (8, None, "m"), (7, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string")
    kept = {r.name for r in ngram_join.one_of_each_component(docs, 5, 80).collect()}
    # 5's first text outlives its copy without an id, 3 outlives 5's second text, 4 outlives 6; one of equal rows, one of near ones stays.
    assert kept >= {"a", "c", "j", "m"} and not kept & {"b", "d", "k"}
    assert len(kept & {"e", "f"}) == 1 and len(kept & {"g", "h", "i"}) == 1 and kept & {"l", "n"} == {"l", "n"}


def test_mix_takes_rows_by_their_own_text(spark):
    rows = [(1, f"text number {i} " * (i + 1), "en", "src0") for i in range(8)] + [(None, f"no id {i}", "en", "src0") for i in range(5)] + [
        (10 + i, f"plain {i}", "en", "src0") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for budget in (0, 1, 30, 10_000):
        taken = source_mix.mix(docs, F.lit("d"), {}, F.lit(budget), 1, more=("mark",)).select("doc_id", "mark").distinct().collect()
        kept = source_mix.keep_mix(docs, F.lit("d"), {}, F.lit(budget))
        marks = {(r.doc_id, r.mark) for r in kept.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).collect()}
        assert marks == {(r.doc_id, r.mark) for r in taken} and kept.count() == len(marks)
        assert (budget == 0) == (not marks)


def test_whole_pipeline_on_odd_rows_and_an_empty_table(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        folder = str(tmp_path / name)
        docs.drop("a.b").write.parquet(f"{folder}/documents.parquet")
        read(spark, "/root/testdata/sf0.001", "labels").write.parquet(f"{folder}/labels.parquet")
        at = read(spark, folder, "documents")
        for stage, run in corpus_pipeline.STAGES[:-1]:
            out = write_scratch(run(spark, at, folder), "test")
            assert out.columns == at.columns, stage
            assert out.count() <= at.count(), stage
            at = out
        encoded = corpus_pipeline.run(spark, folder)
        assert encoded.count() == at.count() and encoded.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (encoded.count() == 0) == (name == "none")
