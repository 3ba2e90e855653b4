"""Current-flow closeness: of every node, of the best node, and of the best group by greedy choice."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import centrality, stretched, tidy
from ..sources.scratch import Scratch
from .classes import Classes
from .edges import nodes
from .parts import Parts
from .resistance import MAX_EXACT, Estimates
from .solve import WIDTH, System


def with_centrality(farness: DataFrame) -> DataFrame:
    """node, farness, centrality = n / farness."""
    n = farness.agg(F.count(F.lit(1)).alias("n"))
    return farness.crossJoin(F.broadcast(n)).select("node", "farness", centrality(F.col("n"), F.col("farness")).alias("centrality"))  # one row


def exact_centrality(edges: DataFrame, scratch: Scratch | None = None, reduce: bool | None = None) -> DataFrame:
    """node, farness, centrality of a connected graph, from the exact diagonal; no inverse and no n^2 rows are made."""
    return Parts(edges, scratch or Scratch(edges.sparkSession), reduce=reduce).centralities().drop("part")


def estimated_centrality(edges: DataFrame, factor: float = 200, seed: int = 1) -> DataFrame:
    return with_centrality(Estimates(edges, factor, seed).farness())


def top_nodes(scores: DataFrame, by: str, count: int = 10, ascending: bool = False) -> DataFrame:
    """The first rows by score, rounded to nine decimals; ties go to the least node."""
    rounded = F.round(by, 9)
    return scores.orderBy(rounded.asc() if ascending else rounded.desc(), "node").limit(count)


def most_central(edges: DataFrame) -> DataFrame:
    """One row: the node of the largest centrality, and n / Tr of the inverse grounded there."""
    return top_nodes(exact_centrality(edges), "centrality", 1).select("node", "centrality")


def estimated_most_central(edges: DataFrame, factor: float = 20, trace_factor: float = 200, exact_below: int = 2000, seed: int = 1) -> DataFrame:
    """One row: the node of the least estimated diagonal, and its centrality: exact for graphs of up to `exact_below`
    nodes, else by an estimated trace."""
    e = Estimates(edges, factor, seed)
    node = top_nodes(e.diagonal(), "value", 1, ascending=True).first()["node"]
    n = e.n
    if n <= exact_below:
        farness = exact_centrality(edges).filter(F.col("node") == node)
        return farness.select("node", (F.lit(n) / F.col("farness")).alias("centrality"))
    trace = Estimates(edges, trace_factor, seed, (node,)).trace()
    return trace.select(F.lit(node).alias("node"), (F.lit(n) / F.col("trace")).alias("centrality"))


def _ranked(scores: DataFrame, step: int, ascending: bool) -> DataFrame:
    rounded = F.round("score", 9)
    order = Window.partitionBy("step").orderBy(rounded.asc() if ascending else rounded.desc(), "node")
    return scores.select(F.lit(step).alias("step"), "node", "score").withColumn("rank", F.row_number().over(order)).select("step", "rank", "node", "score")


def _grounded_profile(profile: DataFrame, system: System, node: int, scratch: Scratch) -> DataFrame:
    """node, own, square of the inverse that is grounded at one node more, from those before, the node's column m and
    what the inverse makes of it; no matrix is held.

    From the pseudo-inverse: M_vw = L_vw - m_v - m_w + m_u. From an inverse M: M_vw - m_v m_w / m_u (Schur).
    """
    m = system.column(node)
    both = profile.join(m.join(system.applied(m), "node"), "node")
    row = m.agg(F.sum(F.when(F.col("node") == node, F.col("m"))).alias("u"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    both = both.crossJoin(F.broadcast(row)).filter(F.col("node") != node).withColumn("n", F.lit(float(system.n)))  # one row
    if system.grounded:
        found = both.selectExpr("node", "own - m * m / u AS own", "square - 2 * m / u * y + m * m / u * mm / u AS square")
    else:
        found = both.selectExpr("node", "own - 2 * m + u AS own", "square + n * m * m + mm + n * u * u - 2 * y - 2 * n * m * u AS square")
    return scratch.table(found, "profile")


def exact_greedy(edges: DataFrame, k: int, scratch: Scratch, given: list[int] | None = None, stretch: float = 0.0, most: int = MAX_EXACT) -> tuple[DataFrame, DataFrame]:
    """(step, rank, node, score) of every node at every step, and one row (k, centrality) of the group.

    Step 1 ranks by the diagonal of the pseudo-inverse, ascending; later ones by gain. The first of each step joins
    the group, or the nodes that are `given`, one a step. Of graphs of up to `most` classes of nodes (see Classes) the
    inverse is a table by classes; of others the diagonals of the inverse and of its square are kept, and brought forward
    by two solves a step.
    """
    if given is not None and len(given) != k:
        raise ValueError("a node for each step is needed")
    n = nodes(edges).count()
    matrix = Classes(edges, scratch)
    small = matrix.count() <= most
    if not small:
        profile = scratch.table(System(edges, scratch).profile(), "profile")
    steps, group = [], []
    for step in range(1, min(k, n - 1) + 1):
        if small:
            scores = matrix.diagonal().withColumnRenamed("value", "score") if step == 1 else matrix.gains()
        else:
            scores = profile.select("node", (F.col("own") if step == 1 else F.col("square") / F.col("own")).alias("score"))
        ranked = scratch.table(_ranked(scores, step, step == 1), "ranked")
        steps.append(ranked)
        node = given[step - 1] if given else ranked.filter("rank = 1").first()["node"]
        if small:
            matrix = matrix.ground(node)
        else:
            profile = _grounded_profile(profile, System(edges, scratch, tuple(group)), node, scratch)
        group.append(node)
    total = matrix.trace().withColumnRenamed("trace", "own") if small else profile.agg(F.sum("own").alias("own"))
    value = total.select(F.lit(k).alias("k"), stretched(F.lit(n) / F.col("own"), stretch).alias("centrality"))
    return functools.reduce(DataFrame.union, steps), value


class Sketches:
    """Random projections of an inverse, kept while nodes are grounded one by one.

    `state`: block, node, x0 .. x7; in the blocks below `each` signs of the edges, whose mean squares are the inverse's
    diagonal, in those above signs of the nodes, whose mean squares are the diagonal of its square. When node u is
    grounded a projection x becomes x - m x_u / m_u, m the column of u (of the pseudo-inverse x - x_u + s (m_u - m), s the
    sum of its signs): exactly what the same signs would give if solved for anew.
    """

    def __init__(self, edges: DataFrame, factor: float, seed: int, scratch: Scratch):
        self.edges, self.scratch, self.group = edges, scratch, ()
        e = Estimates(edges, factor, seed, scratch=scratch)
        self.k, self.each, self.system = e.k, -(-e.k // WIDTH), e.system
        signs = e.node_signs(seed).withColumn("block", F.col("block") + self.each)
        self.right = scratch.table(e.edge_signs(seed).unionByName(signs), "right")
        self.state = scratch.table(self.system.solve(self.right, 1e-8)[0], "sketches")

    def ground(self, node: int) -> None:
        m = self.system.column(node)
        here = self.state.filter(F.col("node") == node).select("block", *[F.col(f"x{j}").alias(f"u{j}") for j in range(WIDTH)])
        own = m.filter(F.col("node") == node).select(F.col("m").alias("own"))
        both = self.state.filter(F.col("node") != node).join(here, "block").join(m, "node").crossJoin(F.broadcast(own))  # one row
        if self.group:
            new = [F.expr(f"x{j} - m * u{j} / own AS x{j}") for j in range(WIDTH)]
        else:
            sums = self.right.filter(F.col("block") >= self.each).groupBy("block").agg(*[F.sum(f"b{j}").alias(f"s{j}") for j in range(WIDTH)])
            both = both.join(sums, "block", "left")
            new = [F.expr(f"x{j} - u{j} + coalesce(s{j}, 0D) * (own - m) AS x{j}") for j in range(WIDTH)]
        self.state = self.scratch.table(both.select("block", "node", *new), "sketches")
        self.group += (node,)
        self.system = System(self.edges, self.scratch, self.group)

    def scores(self) -> DataFrame:
        """node, score: the estimated diagonal before any node is grounded, then the gains."""
        square = F.expr(" + ".join(f"x{j} * x{j}" for j in range(WIDTH)))
        above, below = (F.sum(F.when(F.col("block") < self.each if edge else F.col("block") >= self.each, square)) for edge in (False, True))
        return self.state.groupBy("node").agg((above / below if self.group else below / self.k).alias("score"))


def estimated_greedy(edges: DataFrame, k: int, scratch: Scratch, factor: float = 20, trace_factor: float = 200, seed: int = 1, given: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """As exact_greedy, from estimates: the diagonal first, then (M M)_uu over M_uu, each a mean square of projections,
    which are solved for once and brought forward by one column a step (Sketches)."""
    sketches, steps, n = Sketches(edges, factor, seed, scratch), [], nodes(edges).count()
    for step in range(1, k + 1):
        ranked = scratch.table(_ranked(sketches.scores(), step, step == 1), "ranked")
        steps.append(ranked)
        sketches.ground(given[step - 1] if given else ranked.filter("rank = 1").first()["node"])
    value = Estimates(edges, trace_factor, seed, sketches.group, scratch).trace().select(F.lit(k).alias("k"), (F.lit(n) / F.col("trace")).alias("centrality"))
    return functools.reduce(DataFrame.union, steps), value


def compared(left: DataFrame, right: DataFrame, by: str, tolerance: float) -> DataFrame:
    """One row: rows of either side, and how many differ by more than the tolerance or have no partner."""
    both = left.select("node", F.col(by).alias("a")).join(right.select("node", F.col(by).alias("b")), "node", "full_outer")
    wrong = F.coalesce(F.abs(F.col("a") - F.col("b")) > tolerance, F.lit(True))
    return both.agg(F.count("a").alias("left_rows"), F.count("b").alias("right_rows"), F.count_if(wrong).alias("different"))


def tidy_scores(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c), digits) for c in columns})
