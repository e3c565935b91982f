"""Keyword search against small plain-Python versions."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from mailweave.operators import keyword as K


def osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def allowed(word):
    return 0 if len(word) <= 2 else 1 if len(word) <= 5 else 2


def test_edit_distance(spark):
    pick = random.Random(1)
    pairs = [("form", "from"), ("form", "frmo"), ("ca", "abc"), ("abcdef", "badcfe"), ("abcdef", "bacdfe"), ("", "ab"),
             ("abcd", "acbd"), ("abcde", "abxcd"), ("aab", "aba"), ("x", "x")]
    for _ in range(1500):
        a = "".join(pick.choice("abc") for _ in range(pick.randint(0, 7)))
        b = list(a)
        for _ in range(pick.randint(0, 3)):
            at, kind = pick.randint(0, len(b)), pick.randint(0, 3)
            if kind == 0:
                b.insert(at, pick.choice("abc"))
            elif kind == 1 and at < len(b):
                b.pop(at)
            elif kind == 2 and at < len(b):
                b[at] = pick.choice("abc")
            elif at + 1 < len(b):
                b[at], b[at + 1] = b[at + 1], b[at]
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").withColumn("d", K.edit_distance(F.col("a"), F.col("b")))
    for r in rows.collect():
        want = osa(r.a, r.b)
        assert r.d == (want if want <= 2 else None), r


def test_expansion_finds_every_close_word(spark):
    pick = random.Random(2)
    words = sorted({"".join(pick.choice("abcd") for _ in range(pick.randint(1, 8))) for _ in range(600)} | {"x" * 300})
    queries = ["ab", "abc", "abcd", "dabca", "abcdab", "ddccbbaa", "x" * 299, "zz"]
    vocab = spark.createDataFrame([("body_text", w, 1) for w in words] + [("subject", "abc", 1)], "field string, term string, df long")
    terms = spark.createDataFrame([(0, "body_text", i, q) for i, q in enumerate(queries)],
                                  "query_id long, field string, pos int, term string")
    joined = sorted(map(str, K.expand_fuzzy(terms, vocab).collect()))
    assert joined == sorted(map(str, K.expand_request(terms, vocab).collect()))
    got = defaultdict(list)
    for r in K.expand_fuzzy(terms, vocab).collect():
        assert r.field == "body_text"
        got[r.query_term].append((-r.weight, r.term))
    for q in queries:
        want = []
        for w in words:
            d = osa(q, w) if abs(len(q) - len(w)) <= 2 else 9
            if d <= allowed(q) and (d == 0 or 1 - d / min(len(q), len(w)) > 0):
                want.append((-(1 - d / min(len(q), len(w))) if d else -1.0, w))
        want = sorted(want)[:K.MAX_EXPANSIONS]
        assert [w for _, w in sorted(got[q])] == [w for _, w in want], q


MAILS = [
    (1, "Budget review", "The budget numbers, budgets and more budget.", "Budget summary.", "ann@example.com"),
    (2, "Lunch", "We talk about the budget at lunch.", "Lunch plan.", "bob@example.com"),
    (3, "Re: Review", "Nothing to see. Naïve café review reviewed reviewing.", "Review.", "ann.lee@sub.example.com"),
    (4, "", "", "", "carol@example.com"),
]


def mails(spark):
    return spark.createDataFrame(MAILS, "id long, subject string, body_text string, summary string, sender string")


def words_of(text):
    return re.findall(r"[^\W_]+(?:[.'][^\W_]+)*", text.lower())


def test_scores_match_the_formula(spark):
    from tests.test_analysis import Porter

    index = K.Index.of(mails(spark))
    terms = K.exact_terms(K.query_terms(K.one_query(spark, "budget review")))
    got = {(r.id, r.field): r.score for r in K.field_scores(terms, index).collect()}
    columns = {"subject": 1, "body_text": 2, "summary": 3, "sender_text": 4}
    want = {}
    for field, at in columns.items():
        docs = {m[0]: [Porter(w.replace("ï", "i").replace("é", "e")).stem() for w in words_of(m[at])] for m in MAILS}
        docs = {i: d for i, d in docs.items() if d}
        mean = sum(map(len, docs.values())) / len(docs)
        for i, doc in docs.items():
            total = 0.0
            for term in ("budget", "review"):
                tf, df = Counter(doc)[term], sum(term in d for d in docs.values())
                if tf:
                    idf = math.log(1 + (len(docs) - df + .5) / (df + .5))
                    total += idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(doc) / mean))
            if total:
                want[i, field] = total
    assert set(got) == set(want)
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    best = {r.id: r.score for r in K.best_fields(K.field_scores(terms, index)).collect()}
    assert math.isclose(best[1], max(4 * want[1, "subject"], want[1, "body_text"], 2 * want[1, "summary"]))


def test_exact_sender_scores_only_on_the_whole_address(spark):
    index = K.Index.of(mails(spark))
    for text, hits in (("bob@example.com", {2}), ("bob@example.con", set()), ("bob", set())):
        terms = K.exact_terms(K.query_terms(K.one_query(spark, text))).filter("field = 'sender'")
        assert {r.id for r in K.field_scores(terms, index).collect()} == hits
    fuzzy = K.expand_fuzzy(K.query_terms(K.one_query(spark, "bob@example.con")), index.vocab).filter("field = 'sender'")
    assert [(r.term, r.edits) for r in fuzzy.collect()] == [("bob@example.com", 1)]


def test_sender_filter_by_part_wildcard_and_word(spark):
    rows = mails(spark)
    index = K.Index.of(rows)
    for text, ids in (("ANN", {1, 3}), ("bo?@ex*com", {2}), ("carol other", {4}), ("%", set()), ("sub.example.com", {3})):
        assert {r.id for r in K.sender_filter(index, text).collect()} == ids, text


def test_written_index_equals_computed_one(spark, tmp_path):
    rows = mails(spark)
    K.write_index(rows, str(tmp_path / "i"))
    stored, computed = K.Index.read(spark, str(tmp_path / "i")), K.Index.of(rows)
    for name in ("postings", "vocab", "stats"):
        left, right = getattr(stored, name), getattr(computed, name)
        assert sorted(map(str, left.select(sorted(right.columns)).collect())) == sorted(
            map(str, right.select(sorted(right.columns)).collect()))


def highlighted(spark, text):
    rows = mails(spark)
    index, query = K.Index.of(rows), K.one_query(spark, text)
    terms = K.exact_terms(K.query_terms(query))
    hits = K.ranked(K.best_fields(K.field_scores(terms, index)).withColumn("query_id", F.lit(0).cast("long")), 10)
    return {r.id: r.snippet for r in K.highlight(hits, rows, terms, query).collect()}


def test_highlight(spark):
    got = highlighted(spark, "budgets")
    assert got[1] == "The <em>budget</em> numbers, <em>budgets</em> and more <em>budget</em>."
    assert got[2] == "We talk about the <em>budget</em> at lunch."
    got = highlighted(spark, "naive reviews")
    assert got[3] == "Nothing to see. <em>Naïve</em> café <em>review</em> <em>reviewed</em> <em>reviewing</em>."
    assert got[1] == "<em>Budget</em> review".replace("<em>Budget</em> review", "Budget <em>review</em>")
    # A hit on the sender alone has nothing to mark and shows the plain excerpt.
    assert highlighted(spark, "carol@example.com").get(4) == ""


def test_fragment_window(spark):
    text = "x " * 200 + "needle" + " y" * 200
    rows = spark.createDataFrame([(text, ["needle"]), ("needle" + " y" * 200, ["needle"]), ("z " * 200 + "needle", ["needle"]),
                                  ("short needle.", ["needle"]), ("needles", ["needle"]), (text, None)], "t string, w array<string>")
    got = [r[0] for r in rows.select(K.fragment(F.col("t"), F.col("w"), 150)).collect()]
    for fragment in got[:3]:
        assert "<em>needle</em>" in fragment and len(fragment) == 150 + 9
    assert got[3] == "short <em>needle</em>." and got[4] == "needles" and got[5] is None


def test_zero_edits_equal_the_exact_search(spark):
    index = K.Index.of(mails(spark))
    terms = K.query_terms(K.one_query(spark, "at we the"))
    exact = K.field_scores(K.exact_terms(terms.filter(F.length("term") <= 2)), index)
    fuzzy = K.field_scores(K.expand_fuzzy(terms.filter(F.length("term") <= 2), index.vocab), index)
    assert sorted(map(str, exact.collect())) == sorted(map(str, fuzzy.collect()))


def test_a_long_request_reads_the_folders_of_its_terms_only(spark, tmp_path):
    from mailweave.session import scratch_path

    rows = spark.range(300).select(
        "id", F.lit("s").alias("subject"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") % 7) for i in range(60)]).alias("body_text"),
        F.lit("").alias("summary"), F.lit("a@x.org").alias("sender"))
    folder = scratch_path(spark, "index-test")
    K.write_index(rows, folder)
    stored = K.Index.read(spark, folder)
    text = " ".join(f"w{i}x3" for i in range(80))
    terms = K.fixed(K.exact_terms(K.query_terms(K.one_query(spark, text))))
    cut = K.pushed_down(terms, stored)
    wanted = {r.b for r in terms.select(K.term_bucket(F.col("term")).alias("b")).distinct().collect()}
    plan = cut.postings._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "term_bucket" in filters and len(wanted) < stored.postings.select("term_bucket").distinct().count()
    one = sorted((r.id, round(r.score, 6)) for r in K.best_scores(terms, cut).collect())
    two = sorted((r.id, round(r.score, 6)) for r in K.best_fields(K.field_scores(terms, K.Index.of(rows))).collect())
    assert one == two and one
    with pytest.raises(Exception, match="500 characters"):
        K.query_terms(spark.createDataFrame([(1, "x" * 501)], "query_id long, query string")).collect()


def test_counting_in_the_row(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"])], "id long, w array<string>")
    got = {r.id: r.c and [(x.token, x.tf) for x in r.c] for r in rows.select("id", K.counted(F.col("w")).alias("c")).collect()}
    assert got[1] == [("a", 1), ("b", 2)] and got[4] == [("x", 1)] and not got[2] and not got[3]
