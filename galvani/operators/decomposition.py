"""Centrality by bridges: each bridge-free block on its own, and the tree of blocks to put them together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .components import component_of_nodes, connected_components
from .edges import nodes, symmetric
from .parts import Parts
from .resistance import MAX_EXACT, _inverse
from .trees import RootedForest


def bridge_free_blocks(edges: DataFrame, bridges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(block, node) and (block, src, dst): the components without any bridge. A leaf is a block of one node."""
    kept = scratch.table(edges.join(bridges.select("src", "dst"), ["src", "dst"], "left_anti"), "kept")
    placed = scratch.table(component_of_nodes(kept, nodes(edges), scratch.table).select(F.col("component").alias("block"), "node"), "blocks")
    return placed, kept.join(placed.withColumnRenamed("node", "src"), "src").select("block", "src", "dst")


class Giants:
    """The blocks of more than `most` nodes, all in one system (Parts): `blocks` (block), and `diagonal` (block, node,
    value) of their pseudo-inverses, exact or, with a factor, estimated."""

    def __init__(self, blocks: DataFrame, block_nodes: DataFrame, block_edges: DataFrame, scratch: Scratch, factor: float | None):
        self.blocks, self.scratch = blocks, scratch
        edges = scratch.table(block_edges.join(blocks, "block", "left_semi").select("src", "dst"), "giants")
        self.parts = Parts(edges, scratch, self.of(block_nodes).select("node", F.col("block").alias("part")))
        d = self.parts.estimated_diagonal(factor) if factor else self.parts.diagonal()
        self.diagonal = scratch.table(d.withColumnRenamed("part", "block"), "diagonal")

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.blocks, "block", "left_semi")

    def far(self, own: DataFrame) -> DataFrame:
        """block, node, far: of each node of a giant block the sum of w * r + d over all of it (own: block, node, w, d),
        for all of them from one solve of L x = w: sum of w_v R(u, v) = W d_u + sum of w_v d_v - 2 x_u."""
        own = self.of(own)
        x = self.parts.solve(own.select(F.lit(0).alias("block"), "node", F.col("w").alias("b0"))).select("node", F.col("x0").alias("x"))
        both = self.scratch.table(own.join(self.diagonal, ["block", "node"]).join(x, "node"), "far")
        sums = both.groupBy("block").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("value") + F.col("d")).alias("rest"))
        return both.join(sums, "block").select("block", "node", (F.col("weight") * F.col("value") + F.col("rest") - 2 * F.col("x")).alias("far"))


def giant_blocks(block_nodes: DataFrame, block_edges: DataFrame, scratch: Scratch, most: int = MAX_EXACT, factor: float | None = None) -> Giants | None:
    large = scratch.table(block_nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("block"), "large")
    return None if large.isEmpty() else Giants(large, block_nodes, block_edges, scratch, factor)


def not_giant(rows: DataFrame, giants: Giants | None) -> DataFrame:
    return rows.join(giants.blocks, "block", "left_anti") if giants else rows


def link_rows(block_nodes: DataFrame, block_edges: DataFrame, links: DataFrame, giants: Giants | None = None) -> DataFrame:
    """block, link, node, r: the resistance from each marked node to every node of its block, but for giant ones. A block
    is inverted in one task; one without edges, as a leaf is, needs none."""
    block_nodes, block_edges = not_giant(block_nodes, giants), not_giant(block_edges, giants)
    marked = links.select("node").distinct().join(block_nodes, "node").select("block", "node")

    def rows(edges: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        if not len(ends):
            return pd.DataFrame({"block": [], "link": [], "node": [], "r": []})
        block = ends["block"].iloc[0]
        ids, inverse = _inverse(edges)
        d = np.diag(inverse)
        at = np.searchsorted(ids, ends["node"].to_numpy())
        r = d[at][:, None] + d[None, :] - 2 * inverse[at]
        return pd.DataFrame({"block": block, "link": np.repeat(ids[at], len(ids)), "node": np.tile(ids, len(at)), "r": r.ravel()})

    alone, marked = _by_edges(marked, block_edges)
    found = block_edges.groupBy("block").cogroup(marked.groupBy("block")).applyInPandas(rows, "block long, link long, node long, r double")
    return found.union(alone.select("block", F.col("node").alias("link"), "node", F.lit(0.0)))


def _by_edges(rows: DataFrame, block_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of blocks without edges, and those of the others."""
    linked = block_edges.select("block").distinct()
    return rows.join(linked, "block", "left_anti"), rows.join(linked, "block", "left_semi")


class BlockTree:
    """The trees of blocks, rooted at the largest block of each component (of equal ones that of the least name).

    `rows`: block, link (its end of the bridge to its parent), parent, at (the parent's end) of all blocks but the roots;
    `total`: block, total, the nodes of its component; `forest`: the tree itself.
    """

    def __init__(self, block_nodes: DataFrame, bridges: DataFrame, scratch: Scratch):
        at = block_nodes.select("node", "block")
        ends = bridges.select("src", "dst").join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst")
        ends = scratch.table(ends.select("src", "dst", "a", "b"), "ends")
        sizes = block_nodes.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        trees = component_of_nodes(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")), sizes.select(F.col("block").alias("node")), scratch.table)
        placed = scratch.table(sizes.join(trees.withColumnRenamed("node", "block"), "block"), "trees")
        by_tree = placed.groupBy("component").agg(F.max_by("block", F.struct("n", -F.col("block"))).alias("node"), F.sum("n").cast("double").alias("total"))
        self.sizes = placed.select(F.col("block").alias("node"), F.col("n").cast("double").alias("w"))
        self.total = placed.join(by_tree, "component").select("block", "total")
        self.forest = RootedForest(ends.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")), by_tree.select("node"), scratch)
        ways = ends.selectExpr("a AS node", "src AS link", "b AS parent", "dst AS at").union(ends.selectExpr("b", "dst", "a", "src"))
        self.rows = scratch.table(self.forest.parents.join(ways, ["node", "parent"]).select(F.col("node").alias("block"), "link", "parent", "at"), "rooted")


def block_tree(block_nodes: DataFrame, bridges: DataFrame, scratch: Scratch) -> BlockTree:
    return BlockTree(block_nodes, bridges, scratch)


def node_weights(block_nodes: DataFrame, tree: BlockTree, rows: DataFrame, scratch: Scratch, giants: Giants | None = None) -> DataFrame:
    """block, node, w, d: how many nodes hang off a node outside its block (itself included), and their distances to it.

    Resistances along a path add up, so what hangs off a bridge is a sum over the subtree below it: the nodes, their
    distances within their blocks, and for each bridge further down its way times the nodes behind it. What lies above a
    bridge exceeds what lies above its parent's by a term that one aggregation gives, so it is a sum along the path from
    the root. Both are taken in logarithmic rounds (RootedForest); all giant blocks
    are solved for together, three times.
    """
    base = scratch.table(block_nodes.select("block", "node", F.lit(1.0).alias("w"), F.lit(0.0).alias("d")), "weights")
    named = lambda df: df.withColumnRenamed("node", "block")

    def gathered(ends: DataFrame, block: str, link: str, state: DataFrame) -> DataFrame:
        """block, far: the sum of w * r + d over another block, or its own, as seen from its link node there."""
        here = ends.select("block", F.col(block).alias("in"), F.col(link).alias("from"))
        seen = here.join(rows.select(F.col("block").alias("in"), F.col("link").alias("from"), "node", "r"), ["in", "from"])
        seen = seen.join(state.select(F.col("block").alias("in"), "node", "w", "d"), ["in", "node"])
        out = seen.groupBy("block").agg(F.sum(F.col("w") * F.col("r") + F.col("d")).alias("far"))
        if giants:
            far = giants.far(state).select(F.col("block").alias("in"), F.col("node").alias("from"), "far")
            out = out.unionByName(here.join(far, ["in", "from"]).select("block", "far"))
        return out

    def told(state: DataFrame, news: DataFrame) -> DataFrame:
        """news: node, dw, dd."""
        add = news.groupBy("node").agg(F.sum("dw").alias("dw"), F.sum("dd").alias("dd"))
        return scratch.table(state.join(add, "node", "left").selectExpr("block", "node", "w + coalesce(dw, 0D) AS w", "d + coalesce(dd, 0D) AS d"), "weights")

    behind = named(tree.forest.below(tree.sizes))
    within = gathered(tree.rows, "block", "link", base)
    # the way from a block's link to where its child hangs, and over the bridge; from a root it counts nowhere
    entry = tree.rows.select(F.col("block").alias("parent"), F.col("link").alias("entry"))
    inner = tree.rows.select("block", "parent", "at").join(entry, "parent")
    ways = inner.join(rows.select(F.col("block").alias("parent"), F.col("link").alias("entry"), F.col("node").alias("at"), "r"), ["parent", "entry", "at"]).select("block", (F.col("r") + 1).alias("way"))
    if giants:
        marked = entry.select(F.col("parent").alias("block"), F.col("entry").alias("node"), F.lit(1.0).alias("one"))
        one = base.join(marked, ["block", "node"], "left").select("block", "node", F.coalesce("one", F.lit(0.0)).alias("w"), "d")
        far = giants.far(one).select(F.col("block").alias("parent"), F.col("node").alias("at"), "far")
        ways = ways.unionByName(inner.join(far, ["parent", "at"]).select("block", (F.col("far") + 1).alias("way")))
    below = tree.rows.join(behind, "block").join(within, "block").join(ways, "block", "left").fillna(0.0, ["way"])
    below = scratch.table(below.select("block", "link", "parent", "at", "w", "way", "far"), "below")
    sums = named(tree.forest.below(below.select(F.col("block").alias("node"), (F.col("far") + F.col("way") * F.col("w")).alias("far"))))
    below = below.drop("far").join(sums, "block").join(tree.total, "block")
    below = scratch.table(below.selectExpr("block", "link", "parent", "at", "w", "far - way * w + w AS far", "total - w AS rest"), "below")
    state = told(base, below.selectExpr("at AS node", "w AS dw", "far AS dd").union(below.selectExpr("link", "rest", "0D")))
    around = gathered(below, "parent", "at", state)
    more = below.join(around.withColumnRenamed("far", "all"), "block").selectExpr("block AS node", "rest + all - far AS value")
    paths = named(tree.forest.above(more))
    return told(state, below.join(paths, "block").selectExpr("link AS node", "0D AS dw", "value AS dd"))


def decomposed_farness(edges: DataFrame, bridges: DataFrame, scratch: Scratch, most: int = MAX_EXACT, factor: float | None = None) -> DataFrame:
    """node, farness of all nodes, leaves too: in each block the weighted sum of resistances, and the distances beyond.

    Blocks of up to `most` nodes are inverted, each in a task; giant ones are solved for together, exactly or, with a
    factor, with a diagonal estimated from so many projections.
    """
    block_nodes, block_edges = bridge_free_blocks(edges, bridges, scratch)
    block_edges = scratch.table(block_edges, "block_edges")
    ends = bridges.select(F.explode(F.array("src", "dst")).alias("node"))
    giants = giant_blocks(block_nodes, block_edges, scratch, most, factor)
    rows = scratch.table(link_rows(block_nodes, block_edges, ends, giants), "links")
    weights = scratch.table(node_weights(block_nodes, block_tree(block_nodes, bridges, scratch), rows, scratch, giants), "weights")

    def inside(edges: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node")
        w, d = own["w"].to_numpy(), own["d"].sum()
        _, inverse = _inverse(edges)
        diag = np.diag(inverse)
        return pd.DataFrame({"node": own["node"].to_numpy(), "farness": w.sum() * diag + w @ diag - 2 * inverse @ w + d})

    inner = not_giant(block_edges, giants)
    alone, linked = _by_edges(not_giant(weights, giants), inner)
    out = inner.groupBy("block").cogroup(linked.groupBy("block")).applyInPandas(inside, "node long, farness double")
    out = out.unionByName(alone.select("node", F.col("d").alias("farness")))
    return out.unionByName(giants.far(weights).select("node", F.col("far").alias("farness"))) if giants else out


def contracted_graph(bridges: DataFrame, block_nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """a, b, w: inner bridges of length 1, and between ends of inner bridges in one block their resistance."""
    inner = bridges.filter("kind = 'inner'").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w"))
    ends = inner.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    within = rows.join(ends, "node", "left_semi").join(ends.withColumnRenamed("node", "link"), "link", "left_semi")
    return inner.union(within.filter("link < node").select("link", "node", "r"))


def block_distances(paths: DataFrame, block_nodes: DataFrame) -> DataFrame:
    """source, block, dist, entry: the nearest node of each block (the least of equal ones) and how far it is."""
    at = paths.join(block_nodes.select("node", "block"), "node")
    return at.groupBy("source", "block").agg(F.min(F.struct(F.round("dist", 9).alias("dist"), F.col("node").alias("entry"))).alias("x")).select("source", "block", "x.dist", "x.entry")


def leaf_rule(edges: DataFrame, farness: DataFrame) -> DataFrame:
    """node, farness of the leaves from their neighbours: f(neighbour) + n - 2."""
    n = farness.agg(F.count(F.lit(1)).alias("n"))
    both = symmetric(edges)
    leaves = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.min("dst").alias("near")).filter("degree = 1")
    return leaves.join(farness.withColumnRenamed("node", "near"), "near").crossJoin(F.broadcast(n)).select(F.col("src").alias("node"), (F.col("farness") + F.col("n") - 2).alias("farness"))


def is_block_forest(bridges: DataFrame, block_nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: the graph of blocks and bridges has no cycle."""
    at = block_nodes.select("node", "block")
    ends = scratch.table(bridges.select("src", "dst").join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst").select("a", "b"), "ends")
    trees = connected_components(ends.toDF("src", "dst"), scratch.table).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("c"))
    return trees.crossJoin(ends.agg(F.count(F.lit(1)).alias("m"))).select((F.col("m") == F.col("n") - F.col("c")).alias("is_forest"))
