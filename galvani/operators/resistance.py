"""Effective resistances: exact from the pseudo-inverse, estimated from random projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import projections, sign
from ..sources.scratch import Scratch
from .edges import dense_ids, nodes
from .solve import WIDTH, System, blocks_of, columns

#: Nodes of a block of the decomposition that is inverted in one task, and of a graph whose inverse is a table for greedy groups.
MAX_EXACT = 4096


def _inverse(edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(edges[["src", "dst"]].to_numpy())
    a, b = (np.searchsorted(ids, edges[c].to_numpy()) for c in ("src", "dst"))
    n = len(ids)
    lap = np.zeros((n, n))
    lap[a, b] = lap[b, a] = -1.0
    lap[np.arange(n), np.arange(n)] = -lap.sum(1)
    return ids, np.linalg.inv(lap + 1.0 / n) - 1.0 / n


def solved_columns(edges: DataFrame, wanted: DataFrame, scratch: Scratch, tol: float = 1e-12, plan: str = "auto", rows: DataFrame | None = None) -> DataFrame:
    """i, j, val: the pseudo-inverse's columns j of the `wanted` nodes, each the solution of L x = e_j less its mean; all
    rows i, or those of the nodes in `rows` (node)."""
    at = dense_ids(wanted.select("node").distinct(), "node").withColumn("t", F.col("id") - 1)
    at = scratch.table(at.select("node", F.floor(F.col("t") / WIDTH).cast("int").alias("block"), F.pmod("t", F.lit(WIDTH)).cast("int").alias("j")), "wanted")
    right = at.groupBy("block", "node").agg(*[F.max(F.when(F.col("j") == j, 1.0).otherwise(0.0)).alias(f"b{j}") for j in range(WIDTH)])
    x, _ = System(edges, scratch, plan=plan).solve(right, tol)
    x = x if rows is None else x.join(rows.select("node").distinct(), "node", "left_semi")
    long = x.select("block", F.col("node").alias("i"), F.posexplode(F.array(*columns("x"))).alias("j", "val"))
    return long.join(at.withColumnRenamed("node", "of"), ["block", "j"]).select("i", F.col("of").alias("j"), "val")


def pseudo_inverse(edges: DataFrame, scratch: Scratch | None = None, plan: str = "auto") -> DataFrame:
    """i, j, val of the Laplacian's pseudo-inverse, for a connected graph (n^2 rows): its columns, solved for by the plan
    of System. Where only the diagonal or the entries at edges are wanted, Parts has them without n^2 rows."""
    return solved_columns(edges, nodes(edges), scratch or Scratch(edges.sparkSession), plan=plan)


def diagonal(matrix: DataFrame) -> DataFrame:
    return matrix.filter("i = j").select(F.col("i").alias("node"), F.col("val").alias("value"))


def trace(matrix: DataFrame) -> DataFrame:
    return matrix.filter("i = j").agg(F.sum("val").alias("trace"))


def column_squares(matrix: DataFrame) -> DataFrame:
    """node, value: the sum of squares of each column."""
    return matrix.groupBy(F.col("j").alias("node")).agg(F.sum(F.col("val") * F.col("val")).alias("value"))


def pair_resistance(matrix: DataFrame, pairs: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """The pairs with r = L+_uu + L+_vv - 2 L+_uv."""
    d = diagonal(matrix)
    found = pairs.join(d.toDF(u, "du"), u).join(d.toDF(v, "dv"), v).join(matrix.toDF(u, v, "uv"), [u, v])
    return found.select(*pairs.columns, (F.col("du") + F.col("dv") - 2 * F.col("uv")).alias("r"))


def all_pairs_resistance(matrix: DataFrame) -> DataFrame:
    """u, v, r of all pairs u < v."""
    return pair_resistance(matrix, matrix.filter("i < j").select(F.col("i").alias("u"), F.col("j").alias("v")), "u", "v")


def farness_of_pairs(pairs: DataFrame) -> DataFrame:
    """node, farness from (u, v, r): each pair counts at both ends."""
    ends = F.explode(F.array("u", "v")).alias("node")
    return pairs.select(ends, "r").groupBy("node").agg(F.sum("r").alias("farness"))


def farness_of_diagonal(d: DataFrame, value: str = "value") -> DataFrame:
    """node, farness = n d_u + sum of d, from the diagonal of the pseudo-inverse."""
    total = d.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return d.crossJoin(F.broadcast(total)).select("node", (F.col("n") * F.col(value) + F.col("total")).alias("farness"))  # one row


# --- estimators -----------------------------------------------------------------------------------------------------


def _total(terms: list[Column]) -> Column:
    return sum(terms[1:], terms[0])


class Estimates:
    """Estimates over one connected graph from k = factor * ln n projections with a fixed seed, by tables alone.

    Their relative error is about sqrt(2 / k). Noise is a hash of seed, projection and ids; columns past k are zero.
    """

    def __init__(self, edges: DataFrame, factor: float = 20, seed: int = 1, ground: tuple[int, ...] = (), scratch: Scratch | None = None, plan: str = "auto"):
        self.seed, self.system = seed, System(edges, scratch or Scratch(edges.sparkSession), ground, plan)
        self.n, self.k = self.system.n, projections(factor, self.system.n)

    def _signs(self, seed: int, *keys: str) -> list[Column]:
        t = lambda j: F.col("block") * WIDTH + j
        return [F.when(t(j) < self.k, sign(seed, t(j), *keys)).otherwise(0.0) for j in range(WIDTH)]

    def _solve(self, right: DataFrame) -> DataFrame:
        """To a tolerance well below the error of the estimate."""
        return self.system.scratch.table(self.system.solve(right, 1e-5)[0], "solved")

    def _edge_noise(self, seed: int) -> DataFrame:
        """B'r, r signs of the edges that are not grounded."""
        each = self.system.inside.select("src", "dst", blocks_of(self.k).alias("block"))
        each = each.select("block", "src", "dst", F.array(*self._signs(seed, "src", "dst")).alias("r"))
        both = each.select("block", F.col("src").alias("node"), "r").union(each.select("block", "dst", F.transform("r", lambda x: -x)))
        return both.groupBy("block", "node").agg(*[F.sum(F.get("r", F.lit(j))).alias(f"b{j}") for j in range(WIDTH)])

    def _node_noise(self, seed: int, weight: Column) -> DataFrame:
        """Weighted signs of the nodes."""
        each = self.system.nodes.select("node", "into", blocks_of(self.k).alias("block"))
        return each.select("block", "node", *[(weight * s).alias(f"b{j}") for j, s in enumerate(self._signs(seed, "node"))])

    def edge_signs(self, seed: int) -> DataFrame:
        return self._edge_noise(seed)

    def node_signs(self, seed: int) -> DataFrame:
        return self._node_noise(seed, F.lit(1.0))

    def _mean_square(self, solved: DataFrame) -> DataFrame:
        return solved.groupBy("node").agg((F.sum(_total([F.col(c) * F.col(c) for c in columns("x")])) / self.k).alias("value"))

    def diagonal(self) -> DataFrame:
        """diag(L+): the mean square of L+ B'r."""
        return self._mean_square(self._solve(self._edge_noise(self.seed)))

    def embedding(self) -> DataFrame:
        """node, z: vectors of which squared distances are about the resistances."""
        parts = self._solve(self._edge_noise(self.seed)).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("block", F.array(*columns("x")).alias("x")))).alias("z"))
        return parts.select("node", F.transform(F.flatten(F.transform("z", lambda p: p["x"])), lambda x: x / float(self.k) ** 0.5).alias("z"))

    def farness(self) -> DataFrame:
        return farness_of_diagonal(self.diagonal())

    def farness_and_distance(self, targets: DataFrame) -> DataFrame:
        """node, target, r and rest: the resistance to each target (node), and the sum of those to all nodes that are none.
        The targets are a few marked nodes; every node is joined with them by block."""
        solved = self._solve(self._edge_noise(self.seed))
        at = solved.join(targets.select("node").distinct(), "node", "left_semi").select("block", F.col("node").alias("target"), *[F.col(f"x{j}").alias(f"y{j}") for j in range(WIDTH)])
        gap = _total([(F.col(f"x{j}") - F.col(f"y{j}")) ** 2 for j in range(WIDTH)])
        r = solved.join(at, "block").groupBy("node", "target").agg((F.sum(gap) / self.k).alias("r"))
        to_marked = r.groupBy("node").agg(F.sum("r").alias("near"))
        rest = farness_of_diagonal(self._mean_square(solved)).join(to_marked, "node").select("node", (F.col("farness") - F.col("near")).alias("rest"))
        return r.join(rest, "node")

    def trace(self) -> DataFrame:
        """One row: the trace of the grounded inverse (Hutchinson)."""
        solved = self._solve(self._node_noise(self.seed, F.lit(1.0)))
        products = [F.col(f"x{j}") * s for j, s in enumerate(self._signs(self.seed, "node"))]
        return solved.agg((F.sum(_total(products)) / self.k).alias("trace"))

    def squares(self) -> DataFrame:
        """diag(M M) of the grounded inverse M."""
        return self._mean_square(self._solve(self._node_noise(self.seed, F.lit(1.0))))

    def inner_part(self) -> DataFrame:
        """diag(M B'B M) over the edges that are not grounded."""
        return self._mean_square(self._solve(self._edge_noise(self.seed + 1)))

    def boundary_part(self) -> DataFrame:
        """diag(M X M), X the number of edges into the ground; with inner_part the diagonal of M."""
        return self._mean_square(self._solve(self._node_noise(self.seed + 2, F.sqrt("into"))))

    def gains(self) -> DataFrame:
        """node, score: squares over the sum of inner_part and boundary_part; all three are columns of one solve."""
        kinds = (self._node_noise(self.seed, F.lit(1.0)), self._edge_noise(self.seed + 1), self._node_noise(self.seed + 2, F.sqrt("into")))
        each = -(-self.k // WIDTH)
        right = [df.withColumn("block", F.col("block") + i * each) for i, df in enumerate(kinds)]
        solved = self._solve(right[0].unionByName(right[1]).unionByName(right[2]))
        square = _total([F.col(c) * F.col(c) for c in columns("x")])
        above, below = (F.sum(F.when((F.col("block") < each) == first, square)) for first in (True, False))
        return solved.groupBy("node").agg((above / below).alias("score"))


def embedded_resistance(embedding: DataFrame, pairs: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """The pairs with r, the squared distance of their vectors."""
    found = pairs.join(embedding.toDF(u, "zu"), u).join(embedding.toDF(v, "zv"), v)
    gap: Column = F.aggregate(F.zip_with("zu", "zv", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return found.select(*pairs.columns, gap.alias("r"))
