"""Rooted forests: parents, sums over subtrees and sums along paths from the root, in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .bridges import euler_tours, suffixes


class RootedForest:
    """The forest (src, dst) of distinct edges with a root (node) for each of its trees; a root may stand alone.

    Leaves are raked off first: they hang off their only neighbour. What is left is laid out as Euler tours, on which a
    subtree is a stretch between two arcs; sums to a tour's end are found by pointers that reach four times as far each
    round, however deep the trees are.
    """

    def __init__(self, forest: DataFrame, roots: DataFrame, scratch: Scratch):
        self.scratch, self.roots = scratch, roots
        both = forest.select(F.col("src").alias("node"), F.col("dst").alias("far")).union(forest.select("dst", "src"))
        near = both.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("parent"))
        #: node, parent of the leaves
        self.leaves = scratch.table(near.filter("n = 1").join(roots.select("node"), "node", "left_anti").select("node", "parent"), "leaves")
        leaf = self.leaves.select("node")
        inner = forest.join(leaf.toDF("src"), "src", "left_anti").join(leaf.toDF("dst"), "dst", "left_anti").select("src", "dst")
        self.tours = scratch.table(euler_tours(scratch.table(inner, "inner"), roots, scratch), "tours")
        ranks = self._sums(self.tours.withColumn("v", F.lit(1.0)), ["v"]).select("id", F.col("s_v").alias("rank"))
        arcs = self.tours.select("id", "tail", "head").join(ranks, "id")
        up = arcs.select(F.col("tail").alias("head"), F.col("head").alias("tail"), F.col("id").alias("up"), F.col("rank").alias("later"))
        #: node, parent of the others but the roots, and the numbers of the arcs that lead down to it and back
        self.inner = scratch.table(arcs.join(up, ["tail", "head"]).filter("rank > later").select(F.col("head").alias("node"), F.col("tail").alias("parent"), F.col("id").alias("down"), "up"), "inner")
        self.parents = self.leaves.union(self.inner.select("node", "parent"))

    def _sums(self, arcs: DataFrame, names: list[str]) -> DataFrame:
        """The arcs with s_<name>: the sum of each value from an arc to its tour's end, its own included."""
        found = suffixes(arcs, {n: lambda a, b: a + b for n in names}, self.scratch)
        return arcs.join(found.select("id", *[F.col(n).alias(f"s_{n}") for n in names]), "id")

    def below(self, values: DataFrame) -> DataFrame:
        """The values (node, further columns of doubles; a missing row is 0) summed over each node's subtree."""
        names = [c for c in values.columns if c != "node"]
        total = [F.sum(c).alias(c) for c in names]
        own = self.scratch.table(values.join(self.leaves, "node", "left"), "values")
        raked = self.scratch.table(own.select(F.coalesce("parent", "node").alias("node"), *names).groupBy("node").agg(*total), "raked")
        arcs = self.tours.join(raked.withColumnRenamed("node", "tail").withColumn("leads", F.lit(True)), ["tail", "leads"], "left").fillna(0.0, names)
        sums = self._sums(self.scratch.table(arcs, "arcs"), names)
        after = self.scratch.table(sums.select("id", "tail", "leads", *[f"s_{n}" for n in names], *[F.expr(f"s_{n} - {n} AS a_{n}") for n in names]), "after")
        ends = [self.inner.select("node", F.col(c).alias("id")).join(after, "id").select("node", *[(F.col(f"a_{n}") * sign).alias(n) for n in names]) for c, sign in (("down", 1), ("up", -1))]
        inner = ends[0].union(ends[1]).groupBy("node").agg(*total)
        top = after.filter("leads").join(self.roots.select(F.col("node").alias("tail")), "tail").select(F.col("tail").alias("node"), *[F.col(f"s_{n}").alias(n) for n in names])
        found = own.filter("parent IS NOT NULL").select("node", *names).union(inner).union(top)
        alone = raked.join(self.tours.select(F.col("tail").alias("node")), "node", "left_anti")  # no inner node beside it
        return found.union(alone.select("node", *names))

    def above(self, values: DataFrame) -> DataFrame:
        """node, value: the values (node, value; a missing row is 0) summed from below the root down to each node, itself
        included."""
        given = self.scratch.table(values.select("node", F.col("value").cast("double").alias("v")), "values")
        inner = self.inner.join(given, "node", "left").fillna(0.0, ["v"])
        signed = inner.select(F.col("down").alias("id"), "v").union(inner.select("up", -F.col("v")))
        sums = self._sums(self.scratch.table(self.tours.join(signed, "id", "left").fillna(0.0, ["v"]), "arcs"), ["v"])
        at = inner.select("node", F.col("down").alias("id")).join(sums.select("id", "v", "s_v"), "id").select("node", (F.col("v") - F.col("s_v")).alias("value"))
        at = self.scratch.table(at.union(self.roots.select("node", F.lit(0.0))), "paths")
        hanging = self.leaves.join(at.withColumnRenamed("node", "parent"), "parent").join(given, "node", "left")
        return at.union(hanging.select("node", (F.col("value") + F.coalesce("v", F.lit(0.0))).alias("value")))
