"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dealt_out


#: Rows of a node from which on they are no longer gathered in one task.
HUB = 200_000


def _least(rows: DataFrame, wanted: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """u, m: the least v of the rows (u, v) of each u, itself included if it is smaller; and u, v, m of the rows in `wanted`.

    With a `checkpoint` the least ones are written, and rows of a node that has more than HUB are not gathered in the one
    task of its key: these nodes, of which there are at most one in HUB rows, are sent to all tasks instead."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    if checkpoint is None:
        return least.select("u", "m"), wanted.join(least.select("u", "m"), "u")
    least = checkpoint(least)
    hubs, others = least.filter(F.col("n") > HUB).select("u", "m"), least.filter(F.col("n") <= HUB).select("u", "m")
    rest = wanted.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others, "u")
    return least.select("u", "m"), rest.unionByName(wanted.join(F.broadcast(hubs), "u"))


def _large_star(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each node hands its larger neighbours to the least node of its neighbourhood."""
    both = edges.union(edges.select("dst", "src")).toDF("u", "v")
    _, joined = _least(both, both.filter("v > u"), checkpoint)
    return joined.select(F.col("v").alias("src"), F.least("u", "m").alias("dst")).distinct()


def _small_star(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the least of them. Edges point from larger to smaller."""
    rows = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    least, joined = _least(rows, rows, checkpoint)
    return joined.filter("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst")).union(least).distinct()


def connected_components(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for each end of an edge (src, dst).

    `checkpoint` writes a round's edges where all executors can read them and so cuts the lineage. Each round is two
    joins; minima are combined before the shuffle, so a hub is one row for each task, and a hub's edges are joined where
    they are. Rounds are dealt out to as many tasks as their edges need. Self-loops and repeated edges do no harm; edges
    with a null end are left out; an edge table without rows gives an empty result.
    """
    pairs = edges.select(edges.columns[0], edges.columns[1]).toDF("src", "dst").filter("src is not null and dst is not null")
    loops = pairs.filter("src = dst").select(F.col("src").alias("node"))
    state = checkpoint(pairs.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")))
    rows, seen = state.count(), None
    for _ in range(max_rounds):
        with dealt_out(state.sparkSession, 2 * rows):
            if 2 * rows > HUB:
                state = checkpoint(_small_star(checkpoint(_large_star(state, checkpoint)), checkpoint))
            else:
                state = checkpoint(_small_star(_large_star(state)))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        rows, seen = now[0], now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = state.select(F.col("dst").alias("node")).distinct()
    alone = loops.limit(0)
    if not loops.isEmpty():
        alone = loops.distinct().join(state.select(F.col("src").alias("node")).union(roots), "node", "left_anti")
    return state.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.union(alone).select("node", F.col("node").alias("component")))


def component_of_nodes(edges: DataFrame, all_nodes: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, component for every node; a node without an edge is a component of its own."""
    found = connected_components(edges, checkpoint)
    return all_nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(components: DataFrame, drop_single: bool = False) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.filter("size > 1") if drop_single else sizes


def component_lists(components: DataFrame) -> DataFrame:
    """component, nodes (sorted). For components that fit a row."""
    return components.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def largest_component(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The edges of the largest component; of equal ones that with the least node."""
    components = connected_components(edges, checkpoint)
    top = component_sizes(components).orderBy(F.desc("size"), "component").limit(1).select("component")
    kept = components.join(F.broadcast(top), "component", "left_semi")  # one row
    return edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")


def graph_checks(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row: n, m, n_components, is_connected, is_tree."""
    components = connected_components(edges, checkpoint)
    n = components.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component").alias("n_components"))
    both = n.crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))
    connected = F.col("n_components") == 1
    return both.select("n", "m", "n_components", connected.alias("is_connected"), (connected & (F.col("m") == F.col("n") - 1)).alias("is_tree"))
