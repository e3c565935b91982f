"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import discard, write_scratch


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest id in the node's neighbourhood."""
    both = edges.unionByName(_turned(edges))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node itself, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` of every node that has an edge; the smallest id of a component names it.

    ``edges`` has two long columns ``a`` and ``b``; loops, repeated edges and nulls are ignored.  Both steps only group and
    join on node ids, so a node with very many neighbours costs partial minima and a join side that adaptive execution can
    split.  Each round is written to the shared folder and the round before is deleted.  An empty input gives an empty result.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = write_scratch(edges, "components")
    mark = _mark(now)
    while mark[0]:
        after = write_scratch(_small_star(_large_star(now).distinct()).distinct(), "components")
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return nodes.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
