"""Whitespace, truncation, snippets, summaries and embedding text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters counted as blank (Unicode white space plus the four ASCII separators).
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

SUMMARY_INPUT_CHARS = 3000
SUMMARY_CHARS = 250
SUMMARY_SENTENCES = 2
SHORT_TEXT_CHARS = 200
SNIPPET_CONTEXT = 60
THREAD_BODY_CHARS = 500
EMBED_BODY_CHARS = 3000


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is computed once and named.

    Plain substitution would repeat the expression at every use; nested steps, and filters pushed through them, would
    then grow without bound.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rstrip(value: Column) -> Column:
    return F.rtrim(value, F.lit(BLANKS))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def collapse(value: Column) -> Column:
    """Every run of blanks becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(value, f"{BLANK}++", " "))


def clean_body(value: Column) -> Column:
    return collapse(F.coalesce(value, F.lit("")))


def truncate(value: Column, limit: int) -> Column:
    return F.when(F.length(value) <= limit, value).otherwise(
        F.concat(rstrip(F.substring(value, 1, limit - 3)), F.lit("...")))


def search_snippet(text: Column, query: Column, limit: int = SHORT_TEXT_CHARS) -> Column:
    """Text around the first case-insensitive hit of the whole query, else the beginning."""
    def around(at: Column) -> Column:
        start = F.greatest(at - SNIPPET_CONTEXT, F.lit(1))
        # Positions count from one: the hit covers at .. at+len-1 and the context follows.
        length = at + F.length(query) + SNIPPET_CONTEXT - start
        return F.when(at == 0, F.substring(text, 1, limit)).otherwise(F.substring(text, start, length))

    raw = let(F.instr(F.lower(text), F.lower(query)), around)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(
        let(collapse(raw), lambda s: truncate(s, limit)))


def extractive_summary(subject: Column, body: Column) -> Column:
    """First two sentences of ``subject. body``."""
    def of_content(content: Column) -> Column:
        pieces = F.transform(F.split(F.translate(content, "\n", " "), r"\."), strip)
        preview = F.array_join(F.slice(F.filter(pieces, lambda s: s != ""), 1, SUMMARY_SENTENCES), ". ")
        # A preview is empty only without any sentence.
        return let(preview, lambda p: F.when(p == "", truncate(content, SHORT_TEXT_CHARS)).when(
            F.length(p) > SUMMARY_CHARS, F.concat(rstrip(F.substring(p, 1, SUMMARY_CHARS - 3)), F.lit("...")),
        ).otherwise(F.concat(p, F.lit("."))))

    whole = strip(F.concat(subject, F.lit(". "), body))
    return let(let(whole, lambda w: truncate(w, SUMMARY_INPUT_CHARS)), of_content)


def embedding_text(subject: Column, sender: Column, body: Column, summary: Column) -> Column:
    """The labelled lines a mail is embedded as; the summary line is present only when there is one."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Subject: "), subject),
        F.concat(F.lit("From: "), sender),
        F.concat(F.lit("Body: "), truncate(body, EMBED_BODY_CHARS)),
        F.when(summary != "", F.concat(F.lit("Summary: "), summary)),
    )
