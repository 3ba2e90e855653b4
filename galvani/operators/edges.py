"""Projections, joins and aggregates over edge tables (src, dst) with src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge in both directions."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).toDF("src", "dst")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """node, degree; with `all_nodes` also nodes without an edge. Combined before the shuffle, so a hub is a row a task."""
    found = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return found if all_nodes is None else all_nodes.select("node").join(found, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def neighbour_lists(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def size(edges: DataFrame) -> DataFrame:
    """One row: n, m."""
    return nodes(edges).agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("m")))


def without_node(edges: DataFrame, node: int) -> DataFrame:
    return edges.filter((F.col("src") != node) & (F.col("dst") != node))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which no end is in `gone` (node)."""
    ends = gone.select("node").distinct()
    return edges.join(ends, F.col("src") == F.col("node"), "left_anti").join(ends, F.col("dst") == F.col("node"), "left_anti")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges of which both ends are in `kept` (node)."""
    ends = kept.select("node").distinct()
    return edges.join(ends, F.col("src") == F.col("node"), "left_semi").join(ends, F.col("dst") == F.col("node"), "left_semi")


def without_edges(edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The other edges, and the ends of those that go."""
    pairs = gone.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return edges.join(pairs, ["src", "dst"], "left_anti"), nodes(pairs)


def adjacency(edges: DataFrame) -> DataFrame:
    return symmetric(edges).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("val"))


def laplacian(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """i, j, val of D - A. To ground nodes filter them out of both indices: the diagonal keeps the full degree."""
    diagonal = degrees(edges, all_nodes).select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").cast("double").alias("val"))
    return diagonal.unionByName(adjacency(edges).withColumn("val", -F.col("val")))


def laplacian_times(edges: DataFrame, x: DataFrame, value: str = "value") -> DataFrame:
    """node, value of L x for a table (node, value): the sum over a node's edges of its value less the neighbour's.
    Sums are combined before the shuffle."""
    both = symmetric(edges).join(x.select(F.col("node").alias("dst"), F.col(value).alias("there")), "dst")
    sums = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("there").alias("around"))
    return x.select("node", F.col(value).alias("here")).join(sums, "node").select("node", (F.col("degree") * F.col("here") - F.col("around")).alias("value"))


def incidence_sum(edges: DataFrame, value: Column) -> DataFrame:
    """node, value of B'r: each edge gives its value to src and takes it from dst."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), value.alias("value")), F.struct(F.col("dst").alias("node"), (-value).alias("value")))).alias("end")
    return edges.select(ends).groupBy("end.node").agg(F.sum("end.value").alias("value"))


def leaf_counts(edges: DataFrame) -> DataFrame:
    """node, ext: how many neighbours of degree 1 a node has (of an edge alone, either end counts the other)."""
    one = degrees(edges).filter("degree = 1").select(F.col("node").alias("leaf"))
    both = symmetric(edges).toDF("leaf", "node")
    return both.join(one, "leaf", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("ext"))


def first_appearance_ids(pairs: DataFrame, a: str, b: str, position: str) -> DataFrame:
    """node, id: dense ids by first appearance in rows in the order of `position`, column a before column b.

    Nodes are counted in ranges of positions: a range's ids start after the nodes of all ranges before it, so no
    single task sorts all nodes.
    """
    seen = pairs.select(F.explode(F.array(F.struct(F.col(a).alias("node"), (F.col(position) * 2).alias("at")), F.struct(F.col(b).alias("node"), (F.col(position) * 2 + 1).alias("at")))).alias("x"))
    return dense_ids(seen.groupBy("x.node").agg(F.min("x.at").alias("at")), "at")


def dense_ids(rows: DataFrame, by: str, ranges: int | None = None) -> DataFrame:
    """node, id: 1, 2, ... in the order of the distinct whole numbers in `by`, by ranges of about as many rows: cut at
    quantiles of a sketch of bounded size."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = ",".join(f"{i / ranges:.9f}D" for i in range(1, max(2, ranges)))
    cuts = rows.agg(F.expr(f"percentile_approx({by}, array({steps}), 10000)").alias("cuts"))
    placed = rows.crossJoin(F.broadcast(cuts))  # one row
    placed = placed.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(by)))).drop("cuts")
    before = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # `ranges` rows at most
    before = before.select("range", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(by))
    return placed.withColumn("rank", rank).join(F.broadcast(before), "range").select("node", (F.col("before") + F.col("rank")).alias("id"))
