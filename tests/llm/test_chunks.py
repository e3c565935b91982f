"""Content-defined chunks against a plain loop, and successors of documents in every kind of range."""

import hashlib
import random

import pytest

from mailweave.llm import chunk_fingerprints as C


def plain_ends(data: bytes) -> list[int]:
    h, hashes = 0, []
    for b in data:
        h = ((h << 1) + int(C.GEAR[b])) & 0xFFFFFFFF
        hashes.append(h)
    ends, start = [], 0
    while start < len(data):
        end = min(start + C.MOST, len(data))
        for e in range(start + C.LEAST, end + 1):
            if hashes[e - 1] < 1 << (32 - (C.HARD_BITS if e < start + C.NORMAL else C.EASY_BITS)):
                end = e
                break
        ends.append(end)
        start = end
    return ends


def plain_set(text: str) -> dict[str, int]:
    data = text.encode()
    ends = plain_ends(data)
    return {C.digest(data[a:b]): b - a for a, b in zip([0, *ends], ends, strict=False)}


def brute(rows):
    """Rows in their order, each with its successor, by plain loops; rows: (doc_id, text, hash of the text)."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    out = []
    for i, (doc_id, text, _) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + following[:half]
        one, new, after = plain_set(text), plain_set(changed), plain_set(following)
        share = lambda a, b: (sum(n for d, n in a.items() if d in b) / sum(a.values())) if a else float(not b)
        out.append((str(doc_id), len(text), hashlib.sha256(changed.encode()).hexdigest(), C.fingerprint(one), C.fingerprint(new),
                    round(share(one, new), 9), round(share(one, after), 9)))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9))
                  for r in C.with_next(df).collect())


def _hashed(df):
    from pyspark.sql import functions as F

    return [tuple(r) for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgé ñ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80, 400]))) for _ in range(150)]


def test_chunk_ends_are_those_of_a_plain_loop(prose):
    texts = [t.encode() for t in prose] + [b"", b"x" * 5000, bytes(range(256)) * 20]
    assert C.chunk_ends(texts) == [plain_ends(t) for t in texts] and C.chunk_ends([]) == []


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_successors_whatever_the_ranges(spark, prose, ranges):
    rng = random.Random(4)
    rows = [(rng.choice([None, 5, rng.randrange(-50, 10**12)]), t) for t in prose]  # two thirds of the rows have no id or the same one
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        assert found(df) == brute(_hashed(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_documents(spark, odd_docs, no_docs):
    assert found(odd_docs) == brute(_hashed(odd_docs))
    assert C.with_next(no_docs).count() == 0 and C.with_next(no_docs).columns == C.with_next(odd_docs).columns
    one = spark.createDataFrame([(3, "alone in the table, its own successor")], "doc_id int, text string")
    assert found(one) == brute(_hashed(one)) and C.with_next(one).first().near_next == 1.0
    same = spark.createDataFrame([(1, "the same words " * 40)] * 6, "doc_id long, text string")
    assert len({r[2:] for r in found(same)}) == 1 and len(found(same)) == 6


def test_likeness(prose):
    rng = random.Random(6)
    for text in (t for t in prose if len(t) > 1500):
        at = rng.randrange(len(text))
        shifted = text[:at] + "an insertion of some words" + text[at:]
        one, other = (C.chunk_sets([t.encode()])[0] for t in (text, shifted))
        assert C.containment(one, other) > 0.85 and C.chunks_of(C.fingerprint(one)) == one
        assert C.containment(one, C.chunk_sets([text[::-1].encode()])[0]) < 0.1


def test_query(spark, sf):
    got = C.op13_chunk_fingerprints(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect())
    assert rows == brute(_hashed(docs))
