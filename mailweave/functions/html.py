"""Markup to plain text."""

from __future__ import annotations

import html as _html
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailweave.functions.text import collapse

# An ampersand run followed by a semicolon, plain text without ampersands, or a lone ampersand.
_PIECES = r"(&#?[A-Za-z0-9]+;|[^&]+|&)"

# Named entities decoded natively: each standard name closed by a semicolon that stands for one
# Latin-1 character.  Taken from the standard library's table by rule, not listed by hand.
NATIVE_ENTITIES = {
    "&" + name: text for name, text in sorted(html5.items())
    if name.endswith(";") and len(text) == 1 and ord(text) < 256
}

@F.pandas_udf(T.StringType())
def _decode_any(values: pd.Series) -> pd.Series:
    return values.map(_html.unescape, na_action="ignore")


def unescape(markup: Column) -> Column:
    """Decode character references once.

    Rows whose references are all in the native map never leave the JVM.  A row with any other
    ampersand (numeric, unknown or unclosed reference) takes the Arrow path; which one is decided on the input.
    """
    table = F.create_map(*[F.lit(x) for pair in NATIVE_ENTITIES.items() for x in pair])
    pieces = F.regexp_extract_all(markup, F.lit(_PIECES), F.lit(1))
    native = F.array_join(F.transform(pieces, lambda p: F.when(
        p.startswith("&"), F.coalesce(F.try_element_at(table, p), p)).otherwise(p)), "")
    rest = F.exists(pieces, lambda p: p.startswith("&") & F.try_element_at(table, p).isNull())
    # A Python call is evaluated ahead of the CASE for every row, so rows that need none hand it a null.
    decoded = _decode_any(F.when(rest, markup))
    return F.coalesce(decoded, F.when(F.contains(markup, F.lit("&")), native).otherwise(markup))


def html_to_text(markup: Column) -> Column:
    """Decode first, then drop tags, then collapse blanks; escaped tags therefore vanish too."""
    bare = F.regexp_replace(unescape(F.coalesce(markup, F.lit(""))), r"<[^>]++>", " ")
    return collapse(bare)
