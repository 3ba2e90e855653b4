"""Shortest paths over weighted edges: leaves and chains become shortcuts first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .solve import WORTH, independent_ends


def shortest_paths(weighted: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """source, node, dist over undirected edges (a, b, w), w above 0, from starts (source, node).

    Round by round nodes of degree 1 and 2 leave the graph, as in the solver's elimination: a node v with edges p to a
    and q to b leaves the shortcut a - b of p + q, and what starts at v starts at a and at b, p and q further on. What is
    left is searched by rounds that go on from what got nearer (Bellman and Ford); then each round's nodes are given back
    their distances from their two neighbours and what started there. So long chains and deep trees take logarithmic
    rounds; only in what has neither does a round go a single edge, and it ends when nothing gets nearer.

    Of edges that repeat the shortest counts; loops and rows with nulls count nowhere. What a source can't reach has no
    row; a start without edges reaches itself. An empty table of starts gives none.
    """
    table = scratch.table
    known = weighted.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.col("w").cast("double").alias("w"))
    edges = table(known.filter("src < dst AND w IS NOT NULL").groupBy("src", "dst").agg(F.min("w").alias("w")), "edges")
    begin = table(starts.select("source", "node").dropna().distinct().withColumn("dist", F.lit(0.0)), "begin")
    left = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
    rounds = []  # what left, and what started there
    while left:
        out = table(independent_ends(edges, len(rounds)), "out")
        count = out.count()
        if not count or count < WORTH * left:
            break
        rounds.append((out, table(begin.join(out.select("node"), "node", "left_semi").select("source", "node", "dist"), "own")))
        left -= count
        edges, begin = table(_without(edges, out), "edges"), table(_moved(begin, out), "begin")
    dist = _searched(edges, begin, scratch)
    for out, own in reversed(rounds):
        near = _ends(out).select(F.col("node").alias("of"), F.col("far").alias("node"), "w").join(dist, "node")
        found = near.select("source", F.col("of").alias("node"), (F.col("dist") + F.col("w")).alias("dist")).union(own)
        dist = table(dist.union(found.groupBy("source", "node").agg(F.min("dist").alias("dist"))), "dist")
    return dist


def _ends(out: DataFrame) -> DataFrame:
    """node, far, w: the edges of the nodes that leave."""
    return out.selectExpr("node", "inline(filter(array(struct(a AS far, p AS w), struct(b AS far, q AS w)), x -> x.far IS NOT NULL))")


def _without(edges: DataFrame, out: DataFrame) -> DataFrame:
    gone = out.select("node")
    kept = edges.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst", "w")
    shortcuts = out.filter("b IS NOT NULL").selectExpr("least(a, b) AS src", "greatest(a, b) AS dst", "p + q AS w")
    return kept.union(shortcuts).groupBy("src", "dst").agg(F.min("w").alias("w"))


def _moved(begin: DataFrame, out: DataFrame) -> DataFrame:
    stay = begin.join(out.select("node"), "node", "left_anti").select("source", "node", "dist")
    moved = begin.join(_ends(out), "node").select("source", F.col("far").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
    return stay.union(moved).groupBy("source", "node").agg(F.min("dist").alias("dist"))


def _searched(edges: DataFrame, begin: DataFrame, scratch: Scratch) -> DataFrame:
    if edges.isEmpty():
        return begin
    both = edges.selectExpr("src AS node", "dst AS far", "w").union(edges.selectExpr("dst", "src", "w"))
    frontier, best = begin, scratch.state(begin, "dist")
    while True:
        reached = frontier.join(both, "node").groupBy("source", F.col("far").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        nearer = reached.join(best, ["source", "node"], "left").filter(F.col("dist").isNull() | (F.col("new") < F.col("dist") - 1e-12))
        frontier = scratch.table(nearer.select("source", "node", F.col("new").alias("dist")), "frontier")
        if frontier.isEmpty():
            return best
        best = scratch.table(best.union(frontier).groupBy("source", "node").agg(F.min("dist").alias("dist")), "dist", instead_of=best)
