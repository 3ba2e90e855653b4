"""Bridges, their classes, and the bridge-free blocks of a graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .components import component_of_nodes
from .edges import degrees, leaf_counts, nodes
from .ranges import numbered


def spanning_forest(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """src, dst of a spanning forest, and a root (node) of each component that has an edge, in logarithmic rounds.

    In a round each part of the graph takes the least of its outgoing edges in the order of a hash, so no cycle arises
    (Boruvka); parts that are joined so get the name of one of them, by doubling of pointers; of the edges between two
    parts the least stays. Parts are at most half as many after a round.
    """
    edge = F.struct(F.xxhash64("src", "dst").alias("hash"), "src", "dst")
    between = scratch.state(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), edge.alias("e")), "between")
    taken, renamed = [], []
    while not between.isEmpty():
        ends = between.select(F.col("a").alias("part"), F.struct("e", F.col("b").alias("to")).alias("x")).union(between.select("b", F.struct("e", F.col("a").alias("to"))))
        picks = scratch.table(ends.groupBy("part").agg(F.min("x").alias("x")).select("part", "x.to", "x.e.src", "x.e.dst"), "picks")
        taken.append(picks.select("src", "dst"))
        # of two parts that took the same edge the lesser keeps its name
        back = picks.select(F.col("part").alias("to"), F.col("to").alias("beyond"))
        names = picks.join(back, "to").select("part", F.when((F.col("beyond") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("name"))
        moved, last = 1, None
        while moved:  # until the last of the steps led nowhere further
            seen = Observation()
            far = _followed(names, 4).select("part", F.col("name4").alias("name"), F.col("name3").alias("old"))
            far = far.observe(seen, F.count_if(F.col("name") != F.col("old")).alias("moved")).select("part", "name")
            names = last = scratch.table(far, "names", last) if last is not None else scratch.state(far, "names")
            moved = seen.get["moved"] or 0
        renamed.append(names.filter("part <> name").select(F.col("part").alias("node")))
        merged = between.join(names.toDF("a", "na"), "a").join(names.toDF("b", "nb"), "b").filter("na <> nb")
        merged = merged.groupBy(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).agg(F.min("e").alias("e"))
        between = scratch.table(merged, "between", between)
    forest = reduce(DataFrame.union, taken, edges.select("src", "dst").limit(0)).distinct()
    roots = nodes(edges).join(reduce(DataFrame.union, renamed, nodes(edges).limit(0)), "node", "left_anti")
    return forest, roots


def _followed(names: DataFrame, steps: int) -> DataFrame:
    """part, name and name1 .. : where the pointers lead in so many steps more."""
    out = names
    for k in range(1, steps + 1):
        before = "name" if k == 1 else f"name{k - 1}"
        out = out.join(names.toDF(before, f"name{k}"), before)
    return out


def euler_tours(forest: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """id, tail, head, next, leads: each edge of a forest as two arcs, with the id of the arc that follows on its tree's
    tour (null where the tour comes back to the root for the last time), and whether it is its tail's first arc.

    Arcs are numbered by tail and head. After the arc from u to v comes v's arc behind the one to u, or v's first: so a
    join of the arcs with their opposites, and v's first and last number, give the tour; a hub needs no list.
    """
    arcs = forest.select(F.col("src").alias("tail"), F.col("dst").alias("head")).union(forest.select("dst", "src"))
    arcs = scratch.table(numbered(arcs, ["tail", "head"], scratch), "arcs")
    ends = arcs.groupBy(F.col("tail").alias("node")).agg(F.min("id").alias("first"), F.max("id").alias("last"))
    there = ends.join(roots.select("node", F.lit(True).alias("root")), "node", "left").toDF("head", "first", "last", "root")
    opposite = arcs.select(F.col("head").alias("tail"), F.col("tail").alias("head"), F.col("id").alias("opposite"))
    found = arcs.join(opposite, ["tail", "head"]).join(there, "head").join(ends.select(F.col("node").alias("tail"), F.col("first").alias("own_first")), "tail")
    after = F.when(F.col("opposite") < F.col("last"), F.col("opposite") + 1).when(F.col("root"), None).otherwise(F.col("first"))
    return found.select("id", "tail", "head", after.alias("next"), (F.col("id") == F.col("own_first")).alias("leads"))


def suffixes(lists: DataFrame, combine: dict[str, Callable[[Column, Column], Column]], scratch: Scratch) -> DataFrame:
    """The rows (id, next, values) of linked lists with each value combined with all that follow in its list, by pointers
    that reach four times as far each round."""
    values = list(combine)
    here, open_ = scratch.state(lists.select("id", "next", *values), "lists"), 1
    while open_:
        far = here.select("id", F.col("next").alias("n0"), *[F.col(v).alias(f"{v}0") for v in values])
        for k in range(3):
            ahead = here.select(F.col("id").alias(f"n{k}"), F.col("next").alias(f"n{k + 1}"), *[F.col(v).alias(f"{v}_") for v in values])
            far = far.join(ahead, f"n{k}", "left")
            more = [F.when(F.col(f"{v}_").isNull(), F.col(f"{v}{k}")).otherwise(f(F.col(f"{v}{k}"), F.col(f"{v}_"))).alias(f"{v}{k + 1}") for v, f in combine.items()]
            far = far.select("id", f"n{k + 1}", *more)
        seen = Observation()
        far = far.select("id", F.col("n3").alias("next"), *[F.col(f"{v}3").alias(v) for v in values])
        here = scratch.table(far.observe(seen, F.count("next").alias("open")), "lists", here)
        open_ = seen.get["open"] or 0
    return here


def find_bridges(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """src, dst of every bridge, by cycle-space sampling (Pritchard & Thurimella, 2011), in logarithmic rounds.

    Each edge outside a spanning forest gives a random label of 128 bits to its ends. A forest edge is a bridge exactly
    if the labels of the nodes on either side of it cancel out: no edge crosses (by chance with a probability of 2^-128).
    The first arc of a node on the Euler tour carries its labels; the nodes on one side of an edge are those whose arcs
    lie between the edge's two arcs, so their sum is the difference of two sums to the tour's end. Edges to leaves are
    bridges and are put aside first.
    """
    leaf = degrees(edges).filter("degree = 1").select("node", F.lit(True).alias("leaf"))
    ends = edges.join(leaf.toDF("src", "l"), "src", "left").join(leaf.toDF("dst", "m"), "dst", "left")
    edges = scratch.table(ends.select("src", "dst", F.coalesce("l", "m", F.lit(False)).alias("hangs")), "edges")
    hanging, edges = edges.filter("hangs").select("src", "dst"), edges.filter("NOT hangs").select("src", "dst")
    forest, roots = spanning_forest(edges, scratch)
    forest = scratch.table(forest, "forest")
    labels = edges.join(forest, ["src", "dst"], "left_anti").select(F.explode(F.array("src", "dst")).alias("tail"), F.xxhash64(F.lit(1), "src", "dst").alias("x"), F.xxhash64(F.lit(2), "src", "dst").alias("y"))
    labels = labels.groupBy("tail").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).withColumn("leads", F.lit(True))
    tours = scratch.table(euler_tours(forest, roots, scratch).join(labels, ["tail", "leads"], "left").fillna(0, ["x", "y"]), "tours")
    xor = lambda a, b: a.bitwiseXOR(b)
    sums = suffixes(tours, {"x": xor, "y": xor}, scratch).select("id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    # without an arc's own label: its node lies on one side for both arcs
    after = tours.join(sums, "id").select(F.least("tail", "head").alias("src"), F.greatest("tail", "head").alias("dst"), xor(F.col("sx"), F.col("x")).alias("x"), xor(F.col("sy"), F.col("y")).alias("y"))
    found = after.groupBy("src", "dst").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("x = 0 AND y = 0").select("src", "dst")
    return hanging.union(found)


def classify_bridges(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """src, dst, kind: `leaf` if an end has degree 1 in the graph, else `inner`."""
    d = degrees(edges)
    ends = bridges.join(d.toDF("src", "ds"), "src").join(d.toDF("dst", "dd"), "dst")
    return ends.select("src", "dst", F.when((F.col("ds") == 1) | (F.col("dd") == 1), "leaf").otherwise("inner").alias("kind"))


def bridge_statistics(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """One row of shares in per cent: inner bridges of the edges, their ends (each time, and once) of the nodes,
    leaf bridges of the edges and leaves of the nodes."""
    n = nodes(edges).agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))
    ends = bridges.filter("kind = 'inner'").select(F.explode(F.array("src", "dst")).alias("node")).agg(F.count(F.lit(1)).alias("ends"), F.count_distinct("node").alias("end_nodes"))
    kinds = bridges.agg(F.count_if(F.col("kind") == "inner").alias("inner"), F.count_if(F.col("kind") == "leaf").alias("leaf"))
    leaves = degrees(edges).agg(F.count_if(F.col("degree") == 1).alias("leaves"))
    row = n.crossJoin(ends).crossJoin(kinds).crossJoin(leaves)  # one row each
    share = lambda a, b: (100.0 * F.col(a) / F.col(b))
    return row.select(
        share("inner", "m").alias("inner_edges"), share("ends", "n").alias("inner_end_occurrences"), share("end_nodes", "n").alias("inner_end_nodes"), share("leaf", "m").alias("leaf_edges"), share("leaves", "n").alias("leaf_nodes")
    )


def blocks(edges: DataFrame, bridges: DataFrame, scratch: Scratch) -> DataFrame:
    """block, node, is_link, ext: components without the inner bridges, without leaves; is_link marks ends of inner
    bridges, ext counts the leaves of a node. Blocks are named by their least node; single nodes are blocks too."""
    leaves = bridges.filter("kind = 'leaf'").select("src", "dst")
    kept = edges.join(bridges.select("src", "dst"), ["src", "dst"], "left_anti")
    d = degrees(edges)
    leaf = leaves.select(F.explode(F.array("src", "dst")).alias("node")).join(d.filter("degree = 1"), "node", "left_semi").distinct()
    core = nodes(edges).join(leaf, "node", "left_anti")
    placed = component_of_nodes(kept, core, scratch.table)
    link = bridges.filter("kind = 'inner'").select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("is_link", F.lit(True))
    ext = leaf_counts(edges)
    return placed.join(link, "node", "left").join(ext, "node", "left").select(F.col("component").alias("block"), "node", F.coalesce("is_link", F.lit(False)).alias("is_link"), F.coalesce("ext", F.lit(0).cast("long")).alias("ext"))


def block_profile(block_nodes: DataFrame) -> DataFrame:
    """A row for each block: nodes, links, share of links in per cent, size with leaves, the links and the anchors of leaves."""
    count = F.count(F.lit(1))
    return block_nodes.groupBy("block").agg(
        count.alias("nodes"),
        F.count_if("is_link").alias("links"),
        (100.0 * F.count_if("is_link") / count).alias("link_share"),
        F.sum(F.col("ext") + 1).alias("real_size"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_set(F.when(F.col("is_link"), F.col("node")))), lambda x: x.cast("string"))).alias("boundary"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_set(F.when(F.col("ext") > 0, F.col("node")))), lambda x: x.cast("string"))).alias("anchors"),
    )


def bridge_ends(bridges: DataFrame, block_nodes: DataFrame) -> DataFrame:
    """src, dst, src_block, dst_block of the inner bridges."""
    at = block_nodes.select("node", "block")
    inner = bridges.filter("kind = 'inner'").select("src", "dst")
    return inner.join(at.toDF("src", "src_block"), "src", "left").join(at.toDF("dst", "dst_block"), "dst", "left").select("src", "dst", "src_block", "dst_block")


def leaf_classes_apart(edges: DataFrame, bridges: DataFrame) -> DataFrame:
    """One row: no leaf is an anchor of leaves or an end of an inner bridge (but for an edge that is all of its component)."""
    d = degrees(edges).filter("degree = 1").select("node")
    lone = bridges.filter("kind = 'leaf'").join(d.withColumnRenamed("node", "src"), "src", "left_semi").join(d.withColumnRenamed("node", "dst"), "dst", "left_semi")
    inner = bridges.filter("kind = 'inner'").select(F.explode(F.array("src", "dst")).alias("node"))
    anchors = leaf_counts(edges).select("node").join(lone.select(F.explode(F.array("src", "dst")).alias("node")), "node", "left_anti")
    wrong = d.join(inner.union(anchors).distinct(), "node", "left_semi")
    return wrong.agg((F.count(F.lit(1)) == 0).alias("apart"))
