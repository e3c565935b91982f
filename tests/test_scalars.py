"""Edge rows of the scalar functions, expected values worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailweave.functions import headers as H
from mailweave.functions import text as X
from mailweave.functions.html import html_to_text


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_subject(spark):
    cases = {
        None: "", "": "", "Re:": "", "RE:re: FWD:\tfw:  a   b ": "a b", " Re :x": "Re :x", "re[2]: hi": "re[2]: hi",
        "Reply: x": "Reply: x", "x Re: y": "x Re: y", "\x1fRe: z\x1f": "z", "Fwd: Café  du  coin": "Café du coin",
        "Case Kept": "Case Kept",
    }
    assert apply(spark, H.normalized_subject, list(cases)) == list(cases.values())
    once = apply(spark, H.normalized_subject, list(cases.values()))
    assert once == list(cases.values())


def test_address(spark):
    cases = {
        None: "", "": "", " A@B.C ": "a@b.c", "Ann Lee <Ann@X.org>": "ann@x.org", '"Lee, Ann" < ann@x.org >': "ann@x.org",
        "<>": "<>",
    }
    assert apply(spark, H.address, list(cases)) == list(cases.values())


def test_address_list(spark):
    got = apply(spark, H.address_list, ["A@x.org, b@x.org;a@X.org ,, Bob <B@x.org>; c@x.org", "", None])
    assert got == [["a@x.org", "b@x.org", "c@x.org"], [], []]


def test_message_id_and_references(spark):
    assert apply(spark, H.message_id, [" <a@b> ", "<>", "", None, "< a >", "<<x>>"]) == ["a@b", None, None, None, "a", "x"]
    assert apply(spark, H.reference_ids, ["<a@b>\n <c@d>\t<e>", "", None]) == [["a@b", "c@d", "e"], [], []]


def test_dates(spark):
    values = ["Mon, 1 Jan 2024 10:00:00 +0200", "1 Jan 2024 9:05:07 GMT", "Tue, 02 Jan 2024 00:00:00 -0500 (EST)",
              "02 Jan 2024 12:30 +0000", "junk", "", None, "Mon, 1 Foo 2024 10:00:00 +0000"]
    got = apply(spark, lambda c: H.utc_wall_time(H.rfc2822_time(c)), values)
    assert got == [datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 9, 5, 7), datetime(2024, 1, 2, 5),
                   datetime(2024, 1, 2, 12, 30), None, None, None, None]


@pytest.mark.parametrize("limit", [10])
def test_truncate(spark, limit):
    values = ["a" * 9, "a" * 10, "a" * 11, "abcdef   xyz", "é" * 12]
    want = ["a" * 9, "a" * 10, "aaaaaaa...", "abcdef...", "é" * 7 + "..."]
    assert apply(spark, lambda c: X.truncate(c, limit), values) == want


def test_summary(spark):
    values = ["", "One. Two. Three.", "no period", "...", "a\nb. c\nd. e", "x" * 300 + ". y", "word " * 900]
    got = apply(spark, lambda c: X.extractive_summary(F.lit("Hi"), c), values)

    def plain(body, subject="Hi"):
        content = f"{subject}. {body}".strip()
        if len(content) > 3000:
            content = content[:2997].rstrip() + "..."
        parts = [p.strip() for p in content.replace("\n", " ").split(".") if p.strip()]
        text = ". ".join(parts[:2])
        if len(text) > 250:
            text = text[:247].rstrip() + "..."
        return text + ("" if text.endswith(".") else ".")

    assert got == [plain(v) for v in values]
    assert apply(spark, lambda c: X.extractive_summary(F.lit(""), c), [""]) == ["."]


def test_snippet(spark):
    long = "z" * 100 + " needle " + "y" * 100
    values = ["Needle at start " + "a" * 100, long, "b" * 90 + "needle", "nothing here", "", None, "c " * 200]
    got = apply(spark, lambda c: X.search_snippet(c, F.lit("NEEDLE")), values)

    def plain(text, query="NEEDLE"):
        if not text:
            return ""
        at = text.lower().find(query.lower())
        piece = text[:200] if at < 0 else text[max(0, at - 60):at + len(query) + 60]
        return " ".join(piece.split())

    assert got == [plain(v) for v in values]


def test_html(spark):
    cases = {
        "&lt;b&gt;x&lt;/b&gt;": "x", "&amp;lt;": "&lt;", "&#65;": "A", "&#8212;": "—", "&nosuch; y": "&nosuch; y",
        "&copy 2024": "© 2024", "&copy; 2024": "© 2024", "<p>a</p>\n<p>b&nbsp;c</p>": "a b c", "AT&T": "AT&T", "": "",
        None: "", "x &lt y": "x < y", "plain": "plain",
    }
    assert apply(spark, html_to_text, list(cases)) == list(cases.values())


def test_embedding_text(spark):
    got = apply(spark, lambda c: X.embedding_text(F.lit("S"), F.lit("f@x"), F.lit("B"), c), ["sum", "", None])
    assert got == ["Subject: S\nFrom: f@x\nBody: B\nSummary: sum"] + ["Subject: S\nFrom: f@x\nBody: B"] * 2
