"""Chosen entries of a grounded inverse: its diagonal and those at the graph's edges, without the inverse itself."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .ranges import numbered
from .solve import BLOCKS, WIDTH, System, TaskGraph, columns

#: Columns that are solved for at once where the rest of a graph goes by tables.
AT_ONCE = 512


def selected_inverse(system: System, tol: float = 1e-12, rounds: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(node, m) and (src, dst, m): the inverse's diagonal, and its entries at the edges of the system and at those that
    elimination made; a row for each node and edge. Exact.

    What elimination left is solved for column by column, and of each column only its own entry and those at its node's
    edges are kept. Then the rounds of the elimination are taken back: with x_v = (b_v + p x_a + q x_b) / s,
    M_va = (p M_aa + q M_ab) / s, M_vb likewise, and M_vv = (1 + p M_va + q M_vb) / s (1 / s where v has no edge left); a - b is an edge of the graph
    without v, so all that is needed is there.
    """
    if not system.grounded:
        raise ValueError("the system must be grounded")
    scratch, core = system.scratch, system.core
    left = _by_columns(system, tol, rounds) if system.by_columns else _by_tables(system, tol, rounds)
    own = scratch.state(left.filter("src = dst").select(F.col("src").alias("node"), "m"), "own")
    at = scratch.state(left.filter("src < dst").select("src", "dst", "m"), "entries")
    for out in reversed(core.rounds):
        ends = out.join(own.toDF("a", "ma"), "a").join(own.toDF("b", "mb"), "b", "left").withColumns({"src": F.least("a", "b"), "dst": F.greatest("a", "b")})
        ends = ends.join(at, ["src", "dst"], "left").fillna(0.0, ["m", "mb"])
        new = scratch.table(ends.selectExpr("node", "a", "b", "p", "q", "s", "(p * ma + q * m) / s AS va", "if(b IS NULL, 0D, (p * m + q * mb) / s) AS vb"), "entered")
        own = scratch.table(own.union(new.selectExpr("node", "(1 + p * va + q * vb) / s")).union(out.filter("a IS NULL").selectExpr("node", "1 / s")), "own", own)
        sides = new.selectExpr("node", "explode(filter(array(struct(a AS far, va AS m), struct(b AS far, vb AS m)), x -> x.far IS NOT NULL)) AS x")
        at = scratch.table(at.union(sides.selectExpr("least(node, x.far)", "greatest(node, x.far)", "x.m")), "entries", at)
    return own, at


def _by_columns(system: System, tol: float, rounds: int) -> DataFrame:
    """src, dst, m with src <= dst: groups of 64 columns, a task each, to which the graph is dealt out."""
    scratch, core = system.scratch, system.core
    ids = numbered(core.nodes.select("node"), ["node"], scratch)
    group = scratch.table(ids.select("node", F.floor(F.col("id") / (WIDTH * BLOCKS)).cast("int").alias("grp")), "groups")
    groups = group.select("grp").distinct()  # a row for each 64 columns
    nodes = core.nodes.crossJoin(groups).join(group.withColumn("wanted", F.lit(True)), ["node", "grp"], "left").fillna(False, ["wanted"])
    found = nodes.groupBy("grp").cogroup(core.edges.crossJoin(groups.toDF("to")).groupBy("to")).applyInPandas(lambda n, e: _entries(n, e, tol, rounds), "src long, dst long, m double, residual double")
    found = scratch.table(found, "selected")
    worst = found.agg(F.max("residual")).first()[0] or 0.0
    if worst > tol:
        raise ArithmeticError(f"residual {worst} after {rounds} rounds")
    return found.select("src", "dst", "m")


def _entries(nodes: pd.DataFrame, edges: pd.DataFrame, tol: float, rounds: int) -> pd.DataFrame:
    graph, found, worst = TaskGraph(nodes, edges), [], 0.0
    wanted = np.searchsorted(graph.ids, nodes["node"].to_numpy()[nodes["wanted"].to_numpy()])
    for at in np.split(wanted, range(WIDTH, len(wanted), WIDTH)):
        b = np.zeros((len(graph.ids), len(at)))
        b[at, np.arange(len(at))] = 1.0
        x, left = graph.solve(b, np.full(len(at), tol * tol), rounds)
        worst = max(worst, float(left.max(initial=0.0)) ** 0.5)
        for j, u in enumerate(at):
            far = graph.far[slice(*np.searchsorted(graph.near, [u, u + 1]))]
            far = np.concatenate([[u], far[graph.ids[far] > graph.ids[u]]]).astype(int)
            found.append(pd.DataFrame({"src": graph.ids[u], "dst": graph.ids[far], "m": x[far, j]}))
    return pd.concat(found).assign(residual=worst) if found else pd.DataFrame({"src": [], "dst": [], "m": [], "residual": []})


def _by_tables(system: System, tol: float, rounds: int) -> DataFrame:
    """The same from AT_ONCE columns at a time: so many times the nodes is all that is held, whatever the graph's size."""
    scratch, core = system.scratch, system.core
    ids = scratch.table(numbered(core.nodes.select("node"), ["node"], scratch), "ids")
    found = []
    for start in range(0, core.left, AT_ONCE):
        part = ids.filter((F.col("id") >= start) & (F.col("id") < start + AT_ONCE)).withColumn("t", F.col("id") - start)
        wanted = scratch.table(part.select(F.col("node").alias("of"), F.floor(F.col("t") / WIDTH).cast("int").alias("block"), F.pmod("t", F.lit(WIDTH)).cast("int").alias("j")), "wanted")
        blocks = wanted.select("block").distinct()  # AT_ONCE / WIDTH rows
        unit = wanted.groupBy("block", F.col("of").alias("node")).agg(*[F.max(F.when(F.col("j") == j, 1.0).otherwise(0.0)).alias(f"b{j}") for j in range(WIDTH)])
        right = core.nodes.select("node").crossJoin(blocks).join(unit, ["block", "node"], "left").fillna(0.0)
        norms = unit.groupBy("block").agg(*[F.sum(f"b{j}").alias(f"first{j}") for j in range(WIDTH)])
        x = system.solve_core(scratch.table(right, "right"), scratch.table(norms, "norms"), WIDTH, tol, rounds)
        needed = core.edges.select(F.col("src").alias("of"), F.col("dst").alias("node")).join(wanted, "of").select("of", "node", "block", "j").union(wanted.select("of", "of", "block", "j"))
        found.append(scratch.table(needed.join(x, ["block", "node"]).select(F.col("of").alias("src"), F.col("node").alias("dst"), F.element_at(F.array(*columns("x")), F.col("j") + 1).alias("m")), "selected"))
        scratch.drop(x)
    return reduce(DataFrame.union, found) if found else scratch.spark.createDataFrame([], "src long, dst long, m double")
