"""Laplacian systems on tables: elimination of leaves and chains, then conjugate gradients for many right-hand sides.

Right-hand sides are columns 0 .. k - 1, of which WIDTH stand in a row: a table of them is (block, node, b0 .. b7), and
column t is b[t % WIDTH] of block t // WIDTH. Vectors are tables of this kind too; nothing of a graph's size is gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from . import pieces
from .ranges import numbered

#: Right-hand sides of a row, and blocks of them that a task of the column plan takes.
WIDTH, BLOCKS = 8, 8
#: Bytes of a graph and of such a task's vectors up to which the column plan may be taken; they are measured.
COLUMN_BYTES = 64_000_000
#: Nodes up to which a graph goes by columns as it is; leaves and chains of larger ones are eliminated first.
SMALL = 1024
#: Elimination goes on while a round takes at least this share of the nodes that are left.
WORTH = 0.05
#: Edges from which on a graph is tried in pieces, before anything is eliminated, and rounds of that trial.
LARGE, TRIAL = 200_000, 50


def columns(name: str) -> list[str]:
    return [f"{name}{j}" for j in range(WIDTH)]


def blocks_of(k: int) -> Column:
    """A row for each block of columns."""
    return F.explode(F.sequence(F.lit(0), F.lit(-(-k // WIDTH) - 1)))


def independent_ends(edges: DataFrame, turn: int) -> DataFrame:
    """node, a, p, b, q: nodes of degree 1 or 2, no two of them neighbours, with their neighbours and the weights of the
    edges (src, dst, w) to these (b and q are null for a leaf). Of those that could, each is taken that comes before its
    neighbours in the order of a hash, which changes with the turn."""
    both = edges.selectExpr("src AS node", "dst AS far", "w").union(edges.selectExpr("dst", "src", "w"))
    end = F.struct("far", "w")
    near = both.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("lo"), F.max(end).alias("hi")).filter("n <= 2")
    near = near.withColumn("h", F.struct(F.xxhash64(F.lit(turn), "node").alias("hash"), "node"))
    sides = near.select("node", "h", F.explode(F.array("lo.far", "hi.far")).alias("far"))
    later = sides.join(near.select(F.col("node").alias("far"), F.col("h").alias("other")), "far").filter("other < h").select("node").distinct()
    two = F.col("n") == 2
    out = near.join(later, "node", "left_anti")
    return out.select("node", F.col("lo.far").alias("a"), F.col("lo.w").alias("p"), F.when(two, F.col("hi.far")).alias("b"), F.when(two, F.col("hi.w")).alias("q"))


class Elimination:
    """A graph (src, dst, w) with weights `g` of its nodes to the ground, and what is left of it without leaves and chains.

    Round by round a set of nodes of degree 1 or 2, no two of them neighbours, leaves the graph. A node v between a and b with weights p, q and g,
    s = p + q + g, leaves an edge a - b of p q / s, grounds a by p g / s and b by q g / s, and is found again by
    x_v = (b_v + p x_a + q x_b) / s. A node whose neighbours are all grounded is b_v / g at once. All this is exact; chains shrink by a share a round, so rounds are logarithmic in
    their length, and a hub's leaves go at once.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, scratch: Scratch, least: float | None = WORTH):
        self.scratch = scratch
        self.edges, self.nodes = edges, nodes
        #: a table for each round: node, a, p, b, q (b null and q 0 for a leaf; for a node without edges a and p, too), g, s
        self.rounds: list[DataFrame] = []
        self.left = nodes.count()
        while least is not None and self.left > 1:
            out = scratch.table(self._independent(len(self.rounds)), "out")
            count = out.count()
            if not count or count < least * self.left:
                break
            self.rounds.append(out)
            self.left -= count
            self._without(out)

    def _independent(self, turn: int) -> DataFrame:
        out = independent_ends(self.edges, turn).join(self.nodes, "node")
        out = out.select("node", "a", "p", "b", F.coalesce("q", F.lit(0.0)).alias("q"), "g")
        ends = self.edges.select("src").union(self.edges.select("dst")).toDF("node")
        alone = self.nodes.filter("g > 0").join(ends, "node", "left_anti")
        alone = alone.selectExpr("node", "CAST(NULL AS LONG) AS a", "0D AS p", "CAST(NULL AS LONG) AS b", "0D AS q", "g")
        return out.unionByName(alone).withColumn("s", F.expr("p + q + g"))

    def _without(self, out: DataFrame) -> None:
        gone = out.select("node")
        kept = self.edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        new = out.filter("b IS NOT NULL").selectExpr("least(a, b) AS src", "greatest(a, b) AS dst", "p * q / s AS w")
        self.edges = self.scratch.table(kept.select("src", "dst", "w").union(new).groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
        more = out.filter("g > 0 AND a IS NOT NULL").selectExpr("a AS node", "p * g / s AS g").union(out.filter("g > 0 AND b IS NOT NULL").selectExpr("b", "q * g / s"))
        self.nodes = self.scratch.table(self.nodes.join(gone, "node", "left_anti").union(more).groupBy("node").agg(F.sum("g").alias("g")), "nodes")

    def down(self, right: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """The right-hand sides (block, node, b0 ..) of what is left, and for each round those of the nodes that left."""
        names, kept = [c for c in right.columns if c not in ("block", "node")], []
        for out in self.rounds:
            kept.append(self.scratch.table(right.join(out.select("node"), "node", "left_semi"), "own"))
            shares = out.selectExpr("node", "explode(filter(array(struct(a AS far, p / s AS f), struct(b AS far, q / s AS f)), x -> x.far IS NOT NULL)) AS x")
            moved = kept[-1].join(shares, "node").selectExpr("block", "x.far AS node", *[f"x.f * {c} AS {c}" for c in names])
            stay = right.join(out.select("node"), "node", "left_anti").select("block", "node", *names)
            right = self.scratch.table(stay.union(moved).groupBy("block", "node").agg(*[F.sum(c).alias(c) for c in names]), "right")
        return right, kept

    def up(self, x: DataFrame, kept: list[DataFrame], width: int) -> DataFrame:
        """The solution at all nodes from that at those that were left."""
        for out, own in zip(reversed(self.rounds), reversed(kept), strict=True):
            ends = out.selectExpr("node", "s", "explode(filter(array(struct(a AS far, p AS f), struct(b AS far, q AS f)), x -> x.far IS NOT NULL)) AS e").selectExpr("node AS of", "s", "e.far AS node", "e.f AS f")
            seen = ends.join(x, "node").groupBy("block", F.col("of").alias("node")).agg(F.first("s").alias("s"), *[F.expr(e) for e in _each("sum(f * x{j}) AS y{j}", width)])
            found = seen.join(own, ["block", "node"], "left").selectExpr("block", "node", *_each("(y{j} + coalesce(b{j}, 0D)) / s AS x{j}", width))
            alone = own.join(out.filter("a IS NULL").select("node", "s"), "node").selectExpr("block", "node", *_each("b{j} / s AS x{j}", width))
            x = self.scratch.table(x.select("block", "node", *_each("x{j}", width)).union(found).union(alone), "x")
        return x


class System:
    """L x = b of a connected graph, or of what is left of it without the nodes of `ground` (keys, or a table with a
    column node), with their edges still counted on the diagonal. An edge weighs 1, or `w` if there is such a column. A
    grounded graph may have many components, each with a ground of its own.

    plan "columns": groups of right-hand sides, each solved in a task by conjugate gradients over the whole graph, which
    is dealt out to the groups; for graphs whose bytes are measured to be below COLUMN_BYTES. plan "tables": conjugate
    gradients on tables, at any size. The edges are dealt out by their far end once, and stay so over all rounds (cached,
    and read again from the shared folder where an executor is lost). A round is a join of them with the search
    directions and a sum by the near end, combined before the shuffle, so a hub is a row a task; a round's vectors are
    written, so that no plan grows, and deleted when the next ones are there.

    Before, leaves and chains are eliminated (see Elimination). "auto" takes columns where the graph, or else what
    elimination leaves of it, is small enough, and tables otherwise; `reduce` says whether to eliminate (None: unless
    the whole graph goes by columns and has at most SMALL nodes).
    """

    def __init__(self, edges: DataFrame, scratch: Scratch, ground: tuple[int, ...] | DataFrame = (), plan: str = "auto", reduce: bool | None = None):
        if plan not in ("auto", "columns", "tables"):
            raise ValueError(f"no such plan: {plan}")
        weighted = edges.select("src", "dst", (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w"))
        self.scratch, self.grounded = scratch, isinstance(ground, DataFrame) or bool(ground)
        for end, mark in (("src", "a"), ("dst", "b")):
            if isinstance(ground, DataFrame):
                weighted = weighted.join(ground.select(F.col("node").alias(end), F.lit(True).alias(mark)).distinct(), end, "left").fillna(False, [mark])
            else:
                weighted = weighted.withColumn(mark, F.col(end).isin(list(ground)) if ground else F.lit(False))
        self.inside = weighted.filter("NOT a AND NOT b").select("src", "dst", "w")
        both = weighted.selectExpr("src AS node", "w", "a AS gone", "b AS far").union(weighted.selectExpr("dst", "w", "b", "a"))
        nodes = both.filter("NOT gone").groupBy("node").agg(F.sum(F.expr("if(far, w, 0D)")).alias("into"))
        #: node, into: the weight of its edges into the ground
        self.nodes = scratch.table(nodes, "nodes")
        self.n = self.nodes.count()
        self.edges = scratch.table(self.inside.groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
        small = lambda n, m: n * WIDTH * BLOCKS * 8 + m * 24 <= COLUMN_BYTES
        self.whole = plan == "columns" or plan == "auto" and small(self.n, self.edges.count())
        reduce = not (self.whole and self.n <= SMALL) if reduce is None else reduce
        self.core = Elimination(self.edges, self.nodes.select("node", F.col("into").alias("g")), scratch, WORTH if reduce else None)
        self.by_columns = self.whole or plan == "auto" and small(self.core.left, self.core.edges.count())

    def solve(self, right: DataFrame, tol: float = 1e-8, rounds: int = 5000) -> tuple[DataFrame, float]:
        """(block, node, x0 .. x7) for the right-hand sides (block, node, b0 .. b7, or the first of these; rows that are
        missing are 0), of mean zero unless grounded, and the largest relative residual. Raises where the tolerance isn't met in so many rounds."""
        table = self.scratch.table
        width = sum(c in right.columns for c in columns("b"))
        right = table(right.select("block", "node", *columns("b")[:width]), "right")
        # a row for each WIDTH columns and node: as many blocks as there are right-hand sides by eight
        full = self.nodes.select("node").crossJoin(right.select("block").distinct()).join(right, ["block", "node"], "left")
        full = full.selectExpr("block", "node", *_each("coalesce(b{j}, 0D) AS b{j}", width))
        full = table(full if self.grounded else centred(full, "b", width), "right")
        norms = table(full.groupBy("block").agg(*[F.expr(e) for e in _each("sum(b{j} * b{j}) AS first{j}", width)]), "norms")
        right, kept = self.core.down(full)
        x, worst = (self._by_columns if self.by_columns else self._by_tables)(right, norms, width, tol, rounds)
        x = self.core.up(x, kept, width)
        return x if self.grounded else centred(x, "x", width), worst

    def solve_core(self, right: DataFrame, norms: DataFrame, width: int, tol: float, rounds: int) -> DataFrame:
        """The solutions on what elimination left, by tables; the caller may drop them from the scratch folder."""
        state, _ = self._iterated(right, norms, width, tol, rounds)
        return self.scratch.table(state.selectExpr("block", "node", *_each("x{j}", width)), "x", state)

    def column(self, node: int, tol: float = 1e-12) -> DataFrame:
        """node, m: the column of a node in the inverse (the pseudo-inverse unless grounded)."""
        unit = self.scratch.spark.createDataFrame([(0, node, 1.0)], "block int, node long, b0 double")
        return self.scratch.table(self.solve(unit, tol)[0].select("node", F.col("x0").alias("m")), "column")

    def applied(self, values: DataFrame, tol: float = 1e-12) -> DataFrame:
        """node, y: the inverse times the column m of `values`."""
        return self.scratch.table(self.solve(values.select(F.lit(0).alias("block"), "node", F.col("m").alias("b0")), tol)[0].select("node", F.col("x0").alias("y")), "applied")

    def profile(self, tol: float = 1e-12, rounds: int = 5000) -> DataFrame:
        """node, own, square: the diagonal of the inverse and that of its square, exactly: a column for each node.

        Where the graph goes by columns, groups of them are solved in a task each, which gives back sums by node only;
        else the columns stand in a table of n^2 numbers.
        """
        ids = numbered(self.nodes.select("node"), ["node"], self.scratch)
        if not self.whole:
            at = self.scratch.table(ids.select("node", F.floor(F.col("id") / WIDTH).cast("int").alias("block"), F.pmod("id", F.lit(WIDTH)).cast("int").alias("j")), "wanted")
            right = at.groupBy("block", "node").agg(*[F.max(F.when(F.col("j") == j, 1.0).otherwise(0.0)).alias(f"b{j}") for j in range(WIDTH)])
            x, _ = self.solve(right, tol, rounds)
            each = x.join(at.select("block", "node", "j"), ["block", "node"], "left")
            own = F.sum(F.when(F.col("j").isNotNull(), F.element_at(F.array(*columns("x")), F.col("j") + 1)))
            return each.groupBy("node").agg(own.alias("own"), F.sum(F.expr(" + ".join(_each("x{j} * x{j}", WIDTH)))).alias("square"))
        group = self.scratch.table(ids.select(F.col("node").alias("of"), F.floor(F.col("id") / (WIDTH * BLOCKS)).cast("int").alias("grp")), "groups")
        groups = group.select("grp").distinct()  # a row for each 64 columns
        nodes = self.nodes.select("node", F.col("into").alias("g")).crossJoin(groups).join(group.withColumnRenamed("of", "node").withColumn("wanted", F.lit(True)), ["node", "grp"], "left").fillna(False, ["wanted"])
        grounded = self.grounded
        found = nodes.groupBy("grp").cogroup(self.edges.crossJoin(groups.toDF("to")).groupBy("to")).applyInPandas(lambda n, e: _profiles(n, e, grounded, tol, rounds), "node long, own double, square double, residual double")
        found = self.scratch.table(found.groupBy("node").agg(F.sum("own").alias("own"), F.sum("square").alias("square"), F.max("residual").alias("residual")), "profile")
        worst = found.agg(F.max("residual")).first()[0] or 0.0
        if worst > tol:
            raise ArithmeticError(f"residual {worst} after {rounds} rounds")
        return found.select("node", "own", "square")

    def _by_columns(self, right: DataFrame, norms: DataFrame, width: int, tol: float, rounds: int) -> tuple[DataFrame, float]:
        """Groups of BLOCKS blocks, each with the edges, a task each."""
        group = F.floor(F.col("block") / BLOCKS).cast("int")
        given = right.join(norms, "block").join(self.core.nodes, "node").withColumn("grp", group)
        groups = norms.select(group.alias("grp")).distinct()
        edges = self.core.edges.crossJoin(F.broadcast(groups))  # a row for each 64 right-hand sides

        def run(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            return _column_solutions(rows, edges, width, tol, rounds)

        names = ", ".join(_each("x{j} double", width))
        found = given.groupBy("grp").cogroup(edges.groupBy("grp")).applyInPandas(run, f"block int, node long, residual double, {names}")
        found = self.scratch.table(found, "x")
        worst = found.agg(F.max("residual")).first()[0] or 0.0
        if worst > tol:
            raise ArithmeticError(f"residual {worst} after {rounds} rounds")
        return found.drop("residual"), worst

    def _by_tables(self, right: DataFrame, norms: DataFrame, width: int, tol: float, rounds: int) -> tuple[DataFrame, float]:
        state, worst = self._iterated(right, norms, width, tol, rounds)
        return self.scratch.table(state.selectExpr("block", "node", *_each("x{j}", width)), "x"), worst

    def _iterated(self, right: DataFrame, norms: DataFrame, width: int, tol: float, rounds: int) -> tuple[DataFrame, float]:
        """The steps of all columns come from one sum over the vectors a round (the form of the method by Chronopoulos and
        Gear). They stand in a table, a row for each block; how many columns are unfinished is all that is gathered."""
        parts = int(self.scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        edges, nodes = self.core.edges, self.core.nodes
        both = edges.selectExpr("src", "dst", "w").union(edges.selectExpr("dst", "src", "w")).repartition(parts, "dst").persist()
        try:
            own = both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("around"))
            diagonal = nodes.join(own, "node", "left").select("node", (F.col("g") + F.coalesce("around", F.lit(0.0))).alias("degree"))
            state = right.join(diagonal, "node").selectExpr("block", "node", "degree", *_each("b{j} AS r{j}", width))
            state = state.selectExpr("*", *_each("0D AS x{j}", width), *_each("0D AS p{j}", width), *_each("0D AS s{j}", width), *_each("if(degree > 0, r{j} / degree, 0D) AS u{j}", width))
            pending = state = self.scratch.state(state, "cg")
            before = norms.selectExpr("*", *_each("0D AS gamma{j}", width), *_each("0D AS alpha{j}", width), *_each("false AS done{j}", width))
            before = self.scratch.state(before, "steps")
            for done in range(rounds + 1):
                state = self.scratch.table(_times(both, pending, width), "cg", state)
                before, unfinished, worst = self._steps(state, before, width, tol)
                if not unfinished:
                    break
                if done == rounds:
                    raise ArithmeticError(f"residual {worst} after {rounds} rounds")
                here = state.join(before.selectExpr("block", *_each("alpha{j}", width), *_each("beta{j}", width)), "block")
                here = here.selectExpr("block", "node", "degree", *[e for c in ("x{j}", "r{j}", "alpha{j}", "u{j} + beta{j} * p{j} AS p{j}", "w{j} + beta{j} * s{j} AS s{j}") for e in _each(c, width)])
                here = here.selectExpr("block", "node", "degree", *[e for c in ("p{j}", "s{j}", "x{j} + alpha{j} * p{j} AS x{j}", "r{j} - alpha{j} * s{j} AS r{j}") for e in _each(c, width)])
                # the new vectors and their product with the graph are one job, whose table takes the place of this one
                pending = here.selectExpr("*", *_each("if(degree > 0, r{j} / degree, 0D) AS u{j}", width))
            return state, worst
        finally:
            both.unpersist()

    def _steps(self, state: DataFrame, before: DataFrame, width: int, tol: float) -> tuple[DataFrame, int, float]:
        sums = [F.expr(e) for e in (*_each("sum(r{j} * u{j}) AS g{j}", width), *_each("sum(w{j} * u{j}) AS d{j}", width), *_each("sum(r{j} * r{j}) AS e{j}", width))]
        now = state.groupBy("block").agg(*sums).join(before.select("block", *[c for n in ("first", "gamma", "alpha", "done") for c in _each(n + "{j}", width)]), "block")
        now = now.selectExpr("*", *_each(f"done{{j}} OR e{{j}} <= {tol * tol!r}D * first{{j}} AS stop{{j}}", width))
        now = now.selectExpr("*", *_each("if(gamma{j} <> 0 AND NOT stop{j}, g{j} / gamma{j}, 0D) AS beta{j}", width))
        now = now.selectExpr("*", *_each("d{j} - if(alpha{j} <> 0, beta{j} * g{j} / alpha{j}, 0D) AS lower{j}", width))
        made = now.selectExpr(
            "block", *[e for c in ("first{j}", "g{j} AS gamma{j}", "if(lower{j} > 0 AND NOT stop{j}, g{j} / lower{j}, 0D) AS alpha{j}", "beta{j}", "stop{j} AS done{j}", "if(first{j} > 0, sqrt(e{j} / first{j}), 0D) AS left{j}") for e in _each(c, width)]
        )
        seen = Observation()
        open_ = " + ".join(_each("if(done{j}, 0, 1)", width))
        largest = _each("left{j}", width)
        worst = F.max(F.greatest(*largest) if width > 1 else F.col(largest[0]))
        table = self.scratch.table(made.observe(seen, F.sum(F.expr(open_)).alias("open"), worst.alias("worst")), "steps", before)
        return table, seen.get["open"] or 0, seen.get["worst"] or 0.0


def _times(both: DataFrame, state: DataFrame, width: int) -> DataFrame:
    """The state with w = L u."""
    far = state.selectExpr("block", "node AS dst", *_each("u{j}", width))
    sums = both.join(far, "dst").groupBy("block", F.col("src").alias("node")).agg(*map(F.expr, _each("sum(w * u{j}) AS y{j}", width)))
    kept = [c for c in state.columns if not c.startswith("w")]
    return state.join(sums, ["block", "node"], "left").selectExpr(*kept, *_each("degree * u{j} - coalesce(y{j}, 0D) AS w{j}", width))


class TaskGraph:
    """A whole graph inside a task: its nodes with their weights to the ground, and its edges."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.ids, first = np.unique(nodes["node"].to_numpy(), return_index=True)
        n = len(self.ids)
        a, b = (np.searchsorted(self.ids, edges[c].to_numpy()) for c in ("src", "dst"))
        near, far, w = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(edges["w"].to_numpy(), 2)
        order = np.argsort(near, kind="stable")
        self.near, self.far, self.w = near[order], far[order], w[order, None]
        self.start = np.flatnonzero(np.diff(self.near, prepend=-1))
        self.diagonal = (nodes["g"].to_numpy()[first] + np.bincount(near, w, n))[:, None]
        self.inverse = np.divide(1.0, self.diagonal, out=np.zeros((n, 1)), where=self.diagonal > 0)

    def times(self, x: np.ndarray) -> np.ndarray:
        y = self.diagonal * x
        if len(self.start):
            y[self.near[self.start]] -= np.add.reduceat(self.w * x[self.far], self.start)
        return y

    def solve(self, b: np.ndarray, limit: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Solutions and squared residuals, by Jacobi-preconditioned conjugate gradients until these are within the limit."""
        r, width = b.copy(), b.shape[1]
        x, p, gamma = np.zeros_like(r), np.zeros_like(r), np.zeros(width)
        for _ in range(rounds):
            going = (r * r).sum(0) > limit
            if not going.any():
                break
            u = self.inverse * r
            new = (r * u).sum(0)
            p = u + np.divide(new, gamma, out=np.zeros(width), where=(gamma > 0) & going) * p
            q = self.times(p)
            below = (p * q).sum(0)
            alpha = np.divide(new, below, out=np.zeros(width), where=(below > 0) & going)
            x, r, gamma = x + alpha * p, r - alpha * q, new
        return x, (r * r).sum(0)


def _column_solutions(rows: pd.DataFrame, edges: pd.DataFrame, width: int, tol: float, rounds: int) -> pd.DataFrame:
    """The right-hand sides of a group, block by block."""
    graph, out = TaskGraph(rows, edges), []
    for block, own in rows.groupby("block"):
        own = own.sort_values("node")
        limit = tol * tol * own[[f"first{j}" for j in range(width)]].iloc[0].to_numpy(float)
        x, left = graph.solve(own[[f"b{j}" for j in range(width)]].to_numpy(float), limit, rounds)
        residual = np.sqrt(np.divide(left, limit, out=np.zeros(width), where=limit > 0).max()) * tol
        out.append(pd.DataFrame({"block": block, "node": own["node"].to_numpy(), "residual": residual} | {f"x{j}": x[:, j] for j in range(width)}))
    return pd.concat(out)


def _profiles(nodes: pd.DataFrame, edges: pd.DataFrame, grounded: bool, tol: float, rounds: int) -> pd.DataFrame:
    """node, own, square: of the inverse's columns of the nodes that are `wanted` the squares by row, and their own entries."""
    graph = TaskGraph(nodes, edges)
    n = len(graph.ids)
    wanted = np.searchsorted(graph.ids, nodes["node"].to_numpy()[nodes["wanted"].to_numpy()])
    own, square, worst = np.zeros(n), np.zeros(n), 0.0
    for at in np.split(wanted, range(WIDTH, len(wanted), WIDTH)):
        b = np.zeros((n, len(at)))
        b[at, np.arange(len(at))] = 1.0
        b = b if grounded else b - 1.0 / n
        x, left = graph.solve(b, np.full(len(at), tol * tol), rounds)
        x = x if grounded else x - x.mean(0)
        own[at], worst = x[at, np.arange(len(at))], max(worst, float(left.max()) ** 0.5)
        square += (x * x).sum(1)
    return pd.DataFrame({"node": graph.ids, "own": own, "square": square, "residual": worst})


def _each(text: str, width: int) -> list[str]:
    return [text.format(j=j) for j in range(width)]


def centred(state: DataFrame, name: str, width: int, *keys: str) -> DataFrame:
    """The columns less their means over the nodes of each block, or of each of `keys`."""
    keys = keys or ("block",)
    mean = state.groupBy(*keys).agg(*map(F.expr, _each(f"avg({name}{{j}}) AS m{{j}}", width)))
    others = [c for c in state.columns if c not in _each(f"{name}{{j}}", width)]
    return state.join(mean, list(keys)).selectExpr(*others, *_each(f"{name}{{j}} - m{{j}} AS {name}{{j}}", width))


def solve_by_shuffle(edges: DataFrame, right: DataFrame, names: list[str], scratch: Scratch, tol: float = 1e-5, rounds: int = 2000, ground: tuple[int, ...] = (), plan: str = "tables", reduce: bool | None = None) -> tuple[DataFrame, float]:
    """node and a solution for each of `names` of `right` (node, names), WIDTH at most: L x = b; and the largest residual.

    A graph of more than `LARGE` edges that has no ground, and no `reduce` said, is first tried as it is, in pieces: many mix in a
    few rounds, for which eliminating leaves and chains would cost more. What isn't solved in TRIAL rounds goes by System."""
    if len(names) > WIDTH:
        raise ValueError(f"{WIDTH} columns at a time; use System for more")
    if plan == "tables" and reduce is None and not ground and edges.count() > LARGE:
        found = pieces.solve(edges, right, names, scratch, tol, min(rounds, TRIAL))
        if found:
            return found
    given = right.select(F.lit(0).alias("block"), "node", *[F.col(c).alias(f"b{j}") for j, c in enumerate(names)])
    x, worst = System(edges, scratch, ground, plan, reduce).solve(given, tol, rounds)
    return x.select("node", *[F.col(f"x{j}").alias(c) for j, c in enumerate(names)]), worst
