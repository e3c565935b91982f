"""Rows of a table told apart by id and text, without moving those whose id is theirs alone.

A row whose ``doc_id`` no other row has is named by it.  Rows that share an id, and rows without one, are named by a hash of id and text, below
all ids there are, so that equal texts under one id are one document and different ones are several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import columns, split_by_id, write_scratch

LOWEST = -(1 << 62)  # names made from hashes lie below


def mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def made_name(doc_id: Column, of_text: Column) -> Column:
    """The name of a row that shares its id, or has none."""
    return F.lit(LOWEST) - 1 - F.pmod(F.xxhash64(doc_id.cast("long"), of_text), F.lit(1 << 62))


def told_apart(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` whose id is surely theirs alone, and (name, doc_id, text, r: the row) of all others, which are few where few ids are shared.

    Where every row has an id and none is shared, which the ids alone tell, ``docs`` come back as they are.
    """
    again = write_scratch(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "shared-ids")
    packed = [made_name(F.col("doc_id"), mark()).alias("name"), F.col("doc_id"), F.col("text"), F.struct(*columns(docs)).alias("r")]
    if again.isEmpty() and docs.filter("doc_id is null").isEmpty():
        return docs, docs.limit(0).select(*packed)
    sure, maybe = split_by_id(docs, again)
    return sure.filter("doc_id is not null"), maybe.select(*packed).unionByName(sure.filter("doc_id is null").select(*packed))


def named(plain: DataFrame, odd: DataFrame) -> DataFrame:
    """(doc_id: the name, text) of the rows of ``told_apart``."""
    return plain.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(odd.select(F.col("name").alias("doc_id"), "text"))


def without(plain: DataFrame, odd: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``told_apart`` whose name is not in ``gone`` (doc_id); of rows of one id and text the one that is least as JSON."""
    sure, maybe = split_by_id(plain, gone)
    kept = sure.unionByName(maybe.join(gone.distinct(), "doc_id", "left_anti").select(*columns(plain)))
    left = odd.join(gone.select(F.col("doc_id").alias("name")).distinct(), "name", "left_anti")
    # Which row stays depends on the rows alone, not on where they lie.
    one = left.groupBy("name", "text").agg(F.min_by("r", F.to_json("r")).alias("r"))
    return kept.unionByName(one.select("r.*"))
