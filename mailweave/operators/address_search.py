"""Parts of addresses, found through the distinct addresses and their letter trigrams; mails and their texts are not read.

A pattern's rarest trigrams name the few addresses that can match, the pattern itself decides, and the postings of the exact field give
the mails of an address.  A pattern without three letters in a row is tested against every distinct address.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
RAREST = 2  # trigrams whose lists are met


def grams_of(addresses: DataFrame) -> DataFrame:
    """``(gram, term)``: the distinct letter trigrams of every distinct address ``term``, lower-cased."""
    low = F.lower("term")
    places = F.when(F.length("term") >= GRAM, F.sequence(F.lit(1), F.length("term") - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    cut = F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))
    return addresses.select(F.explode(cut).alias("gram"), "term")


def like_pattern(part: str) -> str:
    """``part`` anywhere; ``*`` and ``?`` match any text and any letter."""
    escaped = part.lower().replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return f"%{escaped.replace('*', '%').replace('?', '_')}%"


def pattern_grams(part: str) -> list[str]:
    """The trigrams that every match has."""
    pieces = re.split(r"[*?]", part.lower())
    return sorted({p[i:i + GRAM] for p in pieces for i in range(len(p) - GRAM + 1)})


def matching(part: str, addresses: DataFrame, grams: DataFrame) -> DataFrame:
    """``(term)``: the distinct addresses that contain ``part``."""
    fits: Column = F.col("term").like(like_pattern(part))
    wanted = pattern_grams(part)
    if not wanted:
        return addresses.select("term").filter(fits)
    # As many rows as the pattern has trigrams.
    counts = {r.gram: r["count"] for r in grams.filter(F.col("gram").isin(wanted)).groupBy("gram").count().collect()}
    if len(counts) < len(wanted):
        return addresses.select("term").limit(0)
    rarest = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
    met = grams.filter(F.col("gram").isin(rarest)).groupBy("term").agg(F.count("*").alias("met"))
    return met.filter((F.col("met") == len(rarest)) & fits).select("term")
