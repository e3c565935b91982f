"""Approximate neighbours of every vector: a graph of short lists, refined by local joins until few lists change.

A neighbour of a neighbour is likely to be a neighbour.  Every vector starts with the best it meets in a few cells.  In a round each
vector is the centre of a small group: the members of its list, a sample of those that have it in theirs, and itself.  A group's
members are scored against each other with one matrix product, and a pair is proposed to a member only where it beats the last
place of that member's list, so that few rows leave a group.  Pairs of members that have met before are left out.  Groups
have a fixed size, so a round's work grows as the number of vectors.

A vector that very many others have in their lists is the centre of one group like any other: what it sees of them is a sample by a seeded
hash, another one each round.  Equal vectors are one node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.operators.skew import first_n_per_key
from mailweave.operators.vectors import DIGITS, cell_centres, distinct_vectors, expanded, met_in_cells
from mailweave.session import discard, materialise

WIDTH = 32  # entries of a list
SAMPLE = 32  # vectors, of those that have a centre in their lists, that join its group
PROBES = 4  # cells that a vector starts from
ROUNDS = 12
SETTLED = 0.01  # share of lists that may still change in the last round
SEED = 31


def _proposals(id_type: str):
    """Group -> ``(node, other, score)``: pairs of members, one of them new to the group, that beat the first one's last place."""
    def meet(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["embedding"].to_numpy()).astype("float64")
        units = np.rint(x @ x.T * 10**DIGITS).astype("int64")
        fresh, last = group["fresh"].to_numpy(dtype=bool), group["last"].to_numpy(dtype="int64")
        wanted = (units > last[:, None]) & (fresh[:, None] | fresh)
        np.fill_diagonal(wanted, False)
        row, col = np.nonzero(wanted)
        member = group["member"].to_numpy()
        return pd.DataFrame({"node": member[row], "other": member[col], "score": units[row, col]})

    return meet, f"node {id_type}, other {id_type}, score long"


def _groups(graph: DataFrame, nodes: DataFrame, turn: int, width: int, sample: int) -> DataFrame:
    """``(centre, member, embedding, fresh, last)``: the groups of a round, without those that hold nothing new."""
    forward = graph.select(F.col("node").alias("centre"), F.col("other").alias("member"), "fresh")
    drawn = graph.select(F.col("other").alias("centre"), F.col("node").alias("member"), "fresh",
                         F.xxhash64(F.lit(SEED + turn), "node", "other").alias("draw"))
    backward = first_n_per_key(drawn, ["centre"], [F.asc("draw")], sample, "member").select("centre", "member", "fresh")
    own = nodes.select(F.col("node").alias("centre"), F.col("node").alias("member"), F.lit(False).alias("fresh"))
    members = forward.unionByName(backward).unionByName(own).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    # The score that a new entry of a member's list has to beat; a list with free places takes any.
    last = graph.groupBy(F.col("node").alias("member")).agg(
        F.when(F.count("*") >= width, F.min("score")).otherwise(F.lit(-(1 << 62))).alias("last"))
    facts = nodes.select(F.col("node").alias("member"), "embedding").join(last, "member", "left").withColumn(
        "last", F.coalesce("last", F.lit(-(1 << 62))))
    live = members.groupBy("centre").agg(F.max("fresh").alias("live")).filter("live").select("centre")
    return members.join(live, "centre", "left_semi").join(facts, "member")


def refine(nodes: DataFrame, start: DataFrame, width: int = WIDTH, sample: int = SAMPLE, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """``(node, other, score)``: lists of up to ``width`` entries, scores in units of the last digit.

    ``nodes``: (node, embedding); ``start``: (node, other, score), the lists to begin with.  Every round's lists are written to the shared
    folder, and the ones before are deleted.
    """
    spark, id_type = nodes.sparkSession, nodes.schema["node"].dataType.simpleString()
    order, count = [F.desc("score"), F.asc("other")], nodes.count()
    first = first_n_per_key(start, ["node"], order, width, "other").select("node", "other", "score", F.lit(True).alias("fresh"))
    graph = materialise(first, "neighbour-lists")
    meet, schema = _proposals(id_type)
    for turn in range(rounds):
        found = _groups(graph, nodes, turn, width, sample).groupBy("centre").applyInPandas(meet, schema)
        known = graph.select("node", "other", "score", F.lit(False).alias("fresh"))
        merged = known.unionByName(found.withColumn("fresh", F.lit(True))).groupBy("node", "other").agg(
            F.max("score").alias("score"), F.min("fresh").alias("fresh"))
        after = materialise(first_n_per_key(merged, ["node"], order, width, "other").select("node", "other", "score", "fresh"), "neighbour-lists")
        discard(spark, graph.inputFiles()[0].rsplit("/", 1)[0])
        graph = after
        if graph.filter("fresh").select("node").distinct().count() <= settled * count:
            break
    return graph.select("node", "other", "score")


def neighbours(vectors: DataFrame, k: int, width: int = WIDTH, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """Approximate ``k`` nearest other vectors of every vector of ``vectors`` (id, embedding): ``(id, other, score, rank)``, ties by id.

    Scores are inner products to ``DIGITS`` digits, cosines of unit vectors.  Lists are as wide as ``k`` asks for and ``width`` at least.
    """
    keep, width = k + 1, max(width, k + 1)
    folded, owners = distinct_vectors(vectors, keep)
    folded = materialise(folded.withColumn("first_id", F.col("ids")[0]), "vectors")
    centres = cell_centres(vectors)
    if not len(centres):
        return vectors.select("id", F.col("id").alias("other"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("rank")).limit(0)
    nodes = folded.select(F.col("first_id").alias("node"), "embedding")
    alone = folded.select("vec", F.array("first_id").alias("ids"), "first_id", "embedding")
    met = met_in_cells(alone, centres, width + 1, PROBES).join(folded.select("vec", F.col("first_id").alias("node")), "vec")
    units = F.round(F.col("score") * 10**DIGITS).cast("long")
    start = met.select("node", F.col("ids")[0].alias("other"), units.alias("score")).filter("node <> other")
    lists = refine(nodes, start, width, sample, rounds)
    # A vector's own copies are neighbours too.
    own = folded.select("vec", "ids", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), DIGITS).alias("score"))
    names = folded.select(F.col("first_id").alias("node"), "vec")
    copies = folded.select(F.col("first_id").alias("other"), "ids")
    best = lists.join(names, "node").join(copies, "other").select("vec", "ids", (F.col("score") / 10**DIGITS).alias("score"))
    return expanded(best.unionByName(own), owners, k)
