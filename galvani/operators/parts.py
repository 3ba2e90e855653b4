"""Many connected graphs in one loop: components, blocks or graphs of a folder, each with its own means and ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.noise import projections, sign
from ..functions.scores import centrality
from ..sources.scratch import Scratch
from .edges import nodes, symmetric
from .ranges import numbered
from .selected import selected_inverse
from .solve import WIDTH, System, blocks_of, centred, columns


class Parts:
    """The pseudo-inverses of all connected parts of a graph (src, dst), by as many jobs as one part needs.

    `parts` (node, part) names them; without it the graph is one part. A node without edges is a part of its own. In each
    part the node of the largest degree (of equal ones the least) is grounded, which leaves one system for all of them;
    what is asked of the pseudo-inverse L+ comes from the grounded inverse M, with zeros for the ground, by
    L+ = (I - J/n) M (I - J/n) in each part. Columns end when their residual over all parts is small enough.
    """

    def __init__(self, edges: DataFrame, scratch: Scratch, parts: DataFrame | None = None, plan: str = "auto", reduce: bool | None = None):
        self.edges, self.scratch = edges, scratch
        named = nodes(edges).withColumn("part", F.lit(0).cast("long")) if parts is None else parts.select("node", "part")
        self.nodes = scratch.table(named, "parts")
        around = symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
        ground = self.nodes.join(around, "node").groupBy("part").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("node"))
        self.ground = scratch.table(ground.select("node"), "ground")
        self.system = System(edges, scratch, self.ground, plan, reduce)
        self.kept: tuple[DataFrame, DataFrame] | None = None

    def solve(self, right: DataFrame, tol: float = 1e-12) -> DataFrame:
        """part, block, node, x0 .. of L+ b in each part, for (block, node, b0 ..); rows that are missing are 0."""
        width = sum(c in right.columns for c in columns("b"))
        every = self.nodes.crossJoin(right.select("block").distinct())  # a row for each eight columns and node
        full = every.join(right, ["block", "node"], "left").fillna(0.0, columns("b")[:width])
        full = centred(full.select("part", "block", "node", *columns("b")[:width]), "b", width, "part", "block")
        x, _ = self.system.solve(full.drop("part"), tol)
        both = every.join(x, ["block", "node"], "left").fillna(0.0, columns("x")[:width])
        return self.scratch.table(centred(both.select("part", "block", "node", *columns("x")[:width]), "x", width, "part", "block"), "x")

    def _selected(self) -> tuple[DataFrame, DataFrame]:
        self.kept = self.kept or selected_inverse(self.system)
        return self.kept

    def diagonal(self) -> DataFrame:
        """part, node, value: the exact diagonals. L+_uu = M_uu - 2 y_u / n + (sum of y) / n^2, y the row sums of M."""
        own, _ = self._selected()
        y = self.system.solve(self.system.nodes.select(F.lit(0).alias("block"), "node", F.lit(1.0).alias("b0")), 1e-12)[0].select("node", F.col("x0").alias("y"))
        each = self.scratch.table(self.nodes.join(own, "node", "left").join(y, "node", "left").fillna(0.0, ["m", "y"]), "profile")
        sums = each.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("all"))
        return self.scratch.table(each.join(sums, "part").selectExpr("part", "node", "m - 2 * y / n + all / (n * n) AS value"), "diagonal")

    def estimated_diagonal(self, factor: float, seed: int = 1) -> DataFrame:
        """part, node, value: the mean squares of L+ B'r, r signs of the edges, k = factor * ln of the largest part."""
        k = projections(factor, self.nodes.groupBy("part").count().agg(F.max("count")).first()[0] or 1)
        t = lambda j: F.col("block") * WIDTH + j
        signs = F.array(*[F.when(t(j) < k, sign(seed, t(j), "src", "dst")).otherwise(0.0) for j in range(WIDTH)])
        each = self.edges.select("src", "dst", blocks_of(k).alias("block")).select("block", "src", "dst", signs.alias("r"))
        both = each.select("block", F.col("src").alias("node"), "r").union(each.select("block", "dst", F.transform("r", lambda x: -x)))
        right = both.groupBy("block", "node").agg(*[F.sum(F.get("r", F.lit(j))).alias(f"b{j}") for j in range(WIDTH)])
        squares = F.sum(F.expr(" + ".join(f"{c} * {c}" for c in columns("x"))))
        return self.solve(self.scratch.table(right, "noise"), 1e-5).groupBy("part", "node").agg((squares / k).alias("value"))

    def resistances(self) -> DataFrame:
        """The edges with r, exact: M_uu + M_vv - 2 M_uv. Of each edge two numbers of the diagonal and one entry are read."""
        own, at = self._selected()
        found = self.edges.join(own.toDF("src", "mu"), "src", "left").join(own.toDF("dst", "mv"), "dst", "left").join(at, ["src", "dst"], "left")
        return found.fillna(0.0, ["mu", "mv", "m"]).select(*self.edges.columns, F.expr("mu + mv - 2 * m AS r"))

    def centralities(self) -> DataFrame:
        """part, node, farness, centrality of all nodes, in their own parts; 0 for a node alone, whose centrality is null."""
        d = self.diagonal()
        sums = d.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("trace"))
        each = d.join(sums, "part").selectExpr("part", "node", "n", "if(n = 1, 0D, n * value + trace) AS farness")
        return each.select("part", "node", "farness", F.when(F.col("farness") > 0, centrality(F.col("n"), F.col("farness"))).alias("centrality"))


class ManyGraphs:
    """Graphs that share names of nodes, (graph_id, src, dst), as one graph in which no two meet.

    `names`: node, graph_id, name; `edges`: src, dst of the new nodes, by which components, bridges, blocks and Parts take
    all graphs in one loop. `named` gives a result's nodes their graph and name again. `others` (graph_id, node) are
    nodes without edges. Rows with a null go.
    """

    def __init__(self, edges: DataFrame, scratch: Scratch, others: DataFrame | None = None):
        ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("name"))
        if others is not None:
            ends = ends.union(others.select("graph_id", F.col("node")))
        ids = numbered(ends.dropna().distinct(), ["graph_id", "name"], scratch)
        self.names = scratch.table(ids.select(F.col("id").alias("node"), "graph_id", "name"), "names")
        at = lambda end, new: self.names.select("graph_id", F.col("name").alias(end), F.col("node").alias(new))
        found = edges.select("graph_id", "src", "dst").join(at("src", "u"), ["graph_id", "src"]).join(at("dst", "v"), ["graph_id", "dst"]).filter("u <> v")
        # numbers keep the order of names within a graph
        self.edges = scratch.table(found.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct(), "edges")

    def named(self, df: DataFrame, *ends: str) -> DataFrame:
        """graph_id, then the columns of a result with the names in place of the new nodes (`ends`, or else node)."""
        ends = ends or ("node",)
        out = df
        for i, end in enumerate(ends):
            keys = self.names.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"), *(["graph_id"] if i == 0 else []))
            out = out.join(keys, end)
        return out.select("graph_id", *[F.col(f"{c}_name").alias(c) if c in ends else F.col(c) for c in df.columns])
