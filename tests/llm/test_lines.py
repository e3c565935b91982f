"""Line dedup: cuckoo filters, reversibility, odd rows."""

import numpy as np

from mailweave.llm import line_dedup as L
from mailweave.llm.cuckoo import CuckooFilter


def test_cuckoo_filter_keeps_all_keys_and_forgets_deleted_ones():
    keys = np.random.default_rng(0).integers(0, 256, (20_000, 16), dtype=np.uint8)
    kept = CuckooFilter.sized(len(keys))
    kept.insert(keys[:15_000])
    kept.insert(keys[15_000:])
    kept = CuckooFilter.load(*kept.dump())
    assert kept.contains(keys).all()
    other = np.random.default_rng(1).integers(0, 256, (20_000, 16), dtype=np.uint8)
    assert kept.contains(other).mean() < 0.005
    kept.delete(keys[:10_000])
    assert kept.contains(keys[10_000:]).all() and kept.contains(keys[:10_000]).mean() < 0.01


def test_overfull_filter_stashes_keys():
    keys = np.random.default_rng(2).integers(0, 256, (300, 16), dtype=np.uint8)
    small = CuckooFilter.sized(10)
    small.insert(keys)
    assert small.stash and small.contains(keys).all()
    assert CuckooFilter.load(*small.dump()).contains(keys).all()


def _plain(rows):
    owners = {}
    key = lambda line: line.strip(L.BLANKS).translate(str.maketrans(L.UPPER, L.LOWER))
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= L.MIN_CHARS:
                owners.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def _got(docs, state):
    return sorted(((r.row.doc_id, r.kept, r.n_lines, r.n_dropped) for r in L.with_kept(docs, state).collect()), key=str)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert _got(odd_docs, L.first_state(odd_docs)) == _plain(rows)
    assert L.with_kept(no_docs, L.first_state(no_docs)).count() == 0
    new = L.rewritten(odd_docs)
    assert new.columns == odd_docs.columns and new.count() == odd_docs.count()


def test_batches_and_deletions_are_reversible(spark):
    text = lambda i: f"common line of all\nline shared by {i // 3} thirds\nonly in document {i}\n{'x' * (i % 12)}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(60)], "doc_id long, text string")
    first, second = docs.filter("doc_id >= 20"), docs.filter("doc_id < 20")
    whole = L.insert(L.insert(L.LineState.empty(spark, 4), first), second)
    at_once = L.first_state(docs, keys_per_shard=40)
    assert _got(docs, whole) == _got(docs, at_once) == _plain([(i, text(i)) for i in range(60)])
    gone = L.delete(whole, second.select("doc_id"))
    assert _got(first, gone) == _plain([(i, text(i)) for i in range(20, 60)]) == _got(first, L.first_state(first))
    refs = lambda s: sorted((bytes(r.key), r.n_docs, r.owner) for r in s.refs.collect())
    assert refs(gone) == refs(L.insert(L.LineState.empty(spark, 4), first))
    back = L.insert(gone, second)
    assert _got(docs, back) == _got(docs, whole) and refs(back) == refs(whole)


def test_delete_is_that_of_one_key_at_a_time():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 256, (3000, 16), dtype=np.uint8)
    for size in (3000, 700):  # with and without a stash
        whole, single = CuckooFilter.sized(size), CuckooFilter.sized(size)
        whole.insert(keys)
        single.insert(keys)
        assert bool(whole.stash) == (size == 700)
        gone = rng.permutation(3000)[:2000]
        whole.delete(keys[gone])
        for i in gone:
            single.delete(keys[i:i + 1])
        assert (whole.table > 0).sum() == (single.table > 0).sum() and sorted(whole.stash) == sorted(single.stash)
        left = np.setdiff1d(np.arange(3000), gone)
        assert whole.contains(keys[left]).all() and whole.contains(keys[gone]).mean() < 0.02
        whole.delete(keys[left])
        assert not whole.table.any() and not whole.stash


def test_filters_grow_with_the_batches(spark):
    """A first batch of few lines, then many times as many: filters are built again and shards split, and the stash stays empty."""
    line = lambda i, j: f"line number {(i * 7 + j) % 900} of the corpus"
    rows = [(i, "\n".join(line(i, j) for j in range(4)) + f"\nonly in document {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    state = L.insert(L.LineState.empty(spark, 1), docs.filter("doc_id < 3"), keys_per_shard=200)
    slots = [state.filters.selectExpr("sum(octet_length(seen)) as n").first().n]
    for low, high in ((3, 40), (40, 200), (200, 600)):
        state = L.insert(state, docs.filter(f"doc_id >= {low} and doc_id < {high}"), keys_per_shard=200)
        sums = state.filters.selectExpr("sum(octet_length(seen)) as n", "sum(octet_length(seen_stash) + octet_length(repeated_stash)) as s").first()
        slots.append(sums.n)
        assert sums.s <= 0.01 * 16 * state.refs.count()
    assert slots[-1] > 50 * slots[0] and state.shards >= 4
    assert state.filters.count() == state.refs.select("shard").distinct().count()
    assert _got(docs, state) == _plain(rows)
    gone = L.delete(state, docs.filter("doc_id >= 100").select("doc_id"))
    assert _got(docs.filter("doc_id < 100"), gone) == _plain(rows[:100])
