"""The pseudo-inverse by classes of nodes that may be exchanged: a few rows where the graph's leaves hang off few nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import tidy
from ..sources.scratch import Scratch
from .edges import nodes, symmetric, without_nodes
from .resistance import solved_columns

#: Nodes of a piece of a class, and pairs of nodes of a task, where the entries of all nodes are written out.
GROUP, PAIRS = 1024, 50_000_000


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else tidy(value, digits)


class Classes:
    """The pseudo-inverse of a connected graph, and later that inverse grounded at some nodes, by classes.

    The leaves of one neighbour are a class, any other node is one by itself. Members of a class may be exchanged without
    changing the graph, so an entry depends on the classes of its two nodes alone, and on whether they are the same node.
    Only the graph without its leaves is solved for, a column a node. All is exact; a graph of c classes takes c^2 rows,
    n^2 if it has no leaves.

    `members`: node, cls; `sizes`: cls, n, own (the entry of a member with itself); `cells`: i, j, val: the entry of a
    member of class i with another node, a member of class j (no row i = j where the class has one member).
    """

    def __init__(self, edges: DataFrame, scratch: Scratch, plan: str = "auto"):
        self.edges, self.scratch, self.plan = edges, scratch, plan
        near = symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("dst").alias("near"))
        # the two ends of an edge alone are no leaves
        inner = near.filter("degree > 1").select(F.col("node").alias("near"), F.lit(True).alias("inner"))
        kind = near.join(inner, "near", "left").withColumn("leaf", F.expr("degree = 1 AND inner IS NOT NULL"))
        kind = kind.selectExpr("node", "leaf", "if(leaf, near, node) AS at")
        named = kind.groupBy("leaf", "at").agg(F.min("node").alias("cls"))
        self._kinds = scratch.table(kind.join(named, ["leaf", "at"]).select("node", "cls", "leaf", "at"), "members")
        self.members = self._kinds.select("node", "cls")
        self.grounded = False
        self._first = scratch.table(self._kinds.groupBy("cls", "leaf", "at").agg(F.count(F.lit(1)).alias("n")), "classes")
        self._solved: tuple[DataFrame, DataFrame] | None = None

    def count(self) -> int:
        """How many classes there are; nothing is solved for yet."""
        return self._first.count()

    def _core(self) -> DataFrame:
        """i, j, val: the pseudo-inverse of what the graph is without its leaves; 0 for one node that is left alone."""
        edges = without_nodes(self.edges.select("src", "dst"), self._kinds.filter("leaf"))
        edges = self.scratch.table(edges, "inner")
        solved = solved_columns(edges, nodes(edges), self.scratch, plan=self.plan)
        alone = self._first.filter("NOT leaf").join(nodes(edges), F.col("at") == F.col("node"), "left_anti")
        return self.scratch.table(solved.union(alone.selectExpr("at AS i", "at AS j", "0D AS val")), "core")

    def _inverse(self) -> tuple[DataFrame, DataFrame]:
        """From the core's pseudo-inverse K, exactly: K_ab, a and b the places of two nodes in the core, and 1 more for a
        leaf with itself, are a generalised inverse of the graph's Laplacian; the pseudo-inverse is that less its means."""
        if self._solved is None:
            core, weight = self._core(), self._first.groupBy(F.col("at").alias("j")).agg(F.sum("n").alias("w"))
            total = self._first.agg(F.sum("n").alias("total"))  # one row
            sums = core.join(weight, "j").groupBy(F.col("i").alias("at")).agg(F.sum(F.expr("w * val")).alias("around"))
            row = self._first.join(sums, "at").crossJoin(F.broadcast(total)).withColumn("mean", F.expr("(around + int(leaf)) / total"))
            row = self.scratch.table(row.select("cls", "leaf", "at", "n", "total", "mean"), "means")
            whole = row.agg(F.sum(F.expr("n * mean / total")).alias("whole"))  # one row
            row = row.crossJoin(F.broadcast(whole)).selectExpr("cls", "leaf", "at", "n", "mean - whole / 2 AS m")
            at_i, at_j = row.selectExpr("at AS i", "cls AS ci", "m AS mi", "n", "int(leaf) AS leaf"), row.selectExpr("at AS j", "cls AS cj", "m AS mj")
            found = core.join(at_i, "i").join(at_j, "j").selectExpr("ci AS i", "cj AS j", "n", "leaf", "val - mi - mj AS val")
            found = self.scratch.table(found, "entries")
            sizes = self.scratch.table(found.filter("i = j").selectExpr("i AS cls", "n", "val + leaf AS own"), "sizes")
            self._solved = sizes, found.filter("i <> j OR n > 1").select("i", "j", "val")
        return self._solved

    @property
    def sizes(self) -> DataFrame:
        return self._inverse()[0]

    @property
    def cells(self) -> DataFrame:
        return self._inverse()[1]

    def _each(self, of_classes: DataFrame) -> DataFrame:
        """node and the columns of its class (cls, ..)."""
        return self.members.join(of_classes, "cls").drop("cls")

    def _pairs(self) -> DataFrame:
        """i, j, val, many (how many nodes of class j another node of class i has), ni, oi, nj, oj."""
        a, b = self.sizes.toDF("i", "ni", "oi"), self.sizes.toDF("j", "nj", "oj")
        return self.cells.join(a, "i").join(b, "j").withColumn("many", F.expr("if(i = j, nj - 1, nj)"))

    def diagonal(self) -> DataFrame:
        return self._each(self.sizes.select("cls", F.col("own").alias("value")))

    def trace(self) -> DataFrame:
        return self.sizes.agg(F.sum(F.expr("n * own")).alias("trace"))

    def column_squares(self) -> DataFrame:
        """node, value: the sum of squares of each column."""
        others = self._pairs().groupBy(F.col("i").alias("cls")).agg(F.sum(F.expr("many * val * val")).alias("others"))
        return self._each(self.sizes.join(others, "cls", "left").select("cls", F.expr("coalesce(others, 0D) + own * own").alias("value")))

    def gains(self) -> DataFrame:
        """node, score: what grounding a node more takes off the trace."""
        return self.column_squares().join(self.diagonal().withColumnRenamed("value", "own"), "node").select("node", (F.col("value") / F.col("own")).alias("score"))

    def grounded_traces(self) -> DataFrame:
        """node, farness: the trace of the inverse grounded at each node, summed from the grounded entries: those of the
        classes' members, each as often as there are such nodes."""
        return self._each(self._pairs().groupBy(F.col("i").alias("cls")).agg(F.sum(F.expr("many * (oj - 2 * val + oi)")).alias("farness")))

    def resistances(self) -> DataFrame:
        """i, j, r, many: the resistance between a member of class i and another node, and how many of these there are."""
        return self._pairs().select("i", "j", F.expr("oi + oj - 2 * val AS r"), "many")

    def farness_of_pairs(self) -> DataFrame:
        """node, farness: the sum of the resistances between a node and all others."""
        return self._each(self.resistances().groupBy(F.col("i").alias("cls")).agg(F.sum(F.expr("many * r")).alias("farness")))

    def pair_resistance(self, pairs: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
        """The pairs of different nodes with r."""
        found = pairs.join(self.members.toDF(u, "i"), u).join(self.members.toDF(v, "j"), v).join(self.resistances().drop("many"), ["i", "j"])
        return found.select(*pairs.columns, "r")

    def _written_out(self, pairs: DataFrame, keep: str) -> DataFrame:
        """u, v, val of all pairs of different nodes that `keep` names, from i, j, val of classes.

        The members of a class are dealt by a hash to pieces of about GROUP nodes, and pairs of pieces to tasks, so what
        is shuffled are two arrays for each million rows, and no class or node is one task's alone. The coalesce, to as
        many tasks as there are, only parts the two explodes: in one generated loop a pair's million rows would wait in
        memory, so these are a piece's rows at a time."""
        n = self.members.count()
        tasks = int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(tasks, -(-n * n // PAIRS))
        piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / GROUP)).cast("int")
        pieces = self.members.join(self.sizes.select("cls", "n"), "cls").groupBy("cls", piece.alias("piece")).agg(F.collect_list("node").alias("nodes"))
        pieces = self.scratch.table(pieces, "pieces")
        named = pieces.select("cls", "piece")
        both = pairs.select("i", "j", "val").join(named.toDF("i", "a"), "i").join(named.toDF("j", "b"), "j")
        # by names alone these are few rows, often one task's; their arrays are joined to them by many
        both = both.repartition(tasks, "i", "a", "j", "b")
        both = both.join(pieces.toDF("i", "a", "us"), ["i", "a"]).join(pieces.toDF("j", "b", "vs"), ["j", "b"]).repartition(parts, "i", "a", "j", "b")
        return both.select(F.explode("us").alias("u"), "vs", "val").coalesce(parts).select("u", F.explode("vs").alias("v"), "val").filter(keep)

    def all_pairs_resistance(self, digits: int | None = None) -> DataFrame:
        """u, v, r of all pairs u < v (n^2 / 2 rows), rounded by classes where `digits` are given."""
        r = F.expr("oi + oj - 2 * val")
        return self._written_out(self._pairs().select("i", "j", _rounded(r, digits).alias("val")), "u < v").withColumnRenamed("val", "r")

    def entries(self, digits: int | None = None) -> DataFrame:
        """i, j, val of all nodes (n^2 rows), rounded by classes where `digits` are given."""
        own = self.diagonal().select(F.col("node").alias("i"), F.col("node").alias("j"), _rounded(F.col("value"), digits).alias("val"))
        return self._written_out(self.cells.select("i", "j", _rounded(F.col("val"), digits).alias("val")), "u <> v").toDF("i", "j", "val").union(own)

    def ground(self, node: int) -> Classes:
        """The inverse that is grounded at one node more. From the pseudo-inverse: M_vw = L_vw - m_v - m_w + m_u, m the
        node's column. From an inverse M: M_vw - m_v m_w / m_u (Schur). The others of its class stay one class."""
        k = self.members.filter(F.col("node") == node).select("cls")
        row = self.scratch.table(self.cells.join(k.withColumnRenamed("cls", "i"), "i").select("j", F.col("val").alias("m")), "row")
        self_ = self.scratch.table(self.sizes.join(k, "cls").select(F.col("cls").alias("k"), F.col("own").alias("u")), "row")  # one row
        # no row says m of a class that has no other member
        sizes = self.sizes.join(row.withColumnRenamed("j", "cls"), "cls").crossJoin(F.broadcast(self_)).withColumn("n", F.expr("if(cls = k, n - 1, n)"))
        cells = self.cells.join(row.toDF("i", "mi"), "i").join(row.toDF("j", "mj"), "j").crossJoin(F.broadcast(self_))
        out = Classes.__new__(Classes)
        out.edges, out.scratch, out.plan, out.grounded, out._first = self.edges, self.scratch, self.plan, True, self._first
        out.members = self.members.filter(F.col("node") != node)
        own, val = ("own - m * m / u", "val - mi * mj / u") if self.grounded else ("own - 2 * m + u", "val - mi - mj + u")
        sizes = self.scratch.table(sizes.selectExpr("cls", "n", f"{own} AS own"), "sizes")
        alone = sizes.filter("n = 1").selectExpr("cls AS i", "cls AS j")
        out._solved = sizes, self.scratch.table(cells.selectExpr("i", "j", f"{val} AS val").join(alone, ["i", "j"], "left_anti"), "cells")
        return out
