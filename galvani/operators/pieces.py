"""Conjugate gradients on a graph dealt out in pieces: L x = b of large graphs in few bytes a round.

A piece is what hashes to one number: its nodes and, for each of its edges, the neighbour; arrays in a row. A piece adds up
what its nodes give to those of another piece, and sends a number for each node that it reaches there with the place of that
node. Rows of single nodes and edges are shuffled once, when the pieces are made.

Nodes that are less than all their neighbours ("low"; no two of them are neighbours) are eliminated without a fill: with
D their degrees and W the weights of their edges, the others ("high") are solved for by S = L_high - W D^-1 W'. A product
with S goes from high nodes to all others, and from low ones back. In a graph of two sides, as orders and parts, that takes
about half as many rounds, and vectors of one side only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import TASK_ROWS, Scratch, dealt_out, tasks_for

#: Rows of edges, both ways and times the right-hand sides, up to which a piece is made; one that has a hub has more.
MOST = 8 * TASK_ROWS

MADE = "kind string, piece int, other int, high int, a binary, b binary, c binary, d binary, e binary"
SENT = "piece int, at binary, sums binary"
VECTORS = ["x", "r", "p", "s", "w"]


def piece_of(node: str, pieces: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(pieces)).cast("int")


def solve(edges: DataFrame, right: DataFrame, names: list[str], scratch: Scratch, tol: float, rounds: int) -> tuple[DataFrame, float] | None:
    """node and a solution for each of `names` of `right` (node, names), of mean zero over all nodes, and the largest
    relative residual; edges (src, dst) weigh 1, or `w`. None where a piece would have more than MOST rows, and where
    the tolerance isn't met in so many rounds."""
    width = len(names)
    rows = 2 * edges.count() * width
    pieces = tasks_for(scratch.spark, rows)
    weights = ["w"] if "w" in edges.columns else []
    both = edges.selectExpr("src AS near", "dst AS far", *weights).union(edges.selectExpr("dst", "src", *weights))
    both = both.select(piece_of("far", pieces).alias("piece"), piece_of("near", pieces).alias("other"), "near", "far", *weights)
    if width * (both.groupBy("piece").count().agg(F.max("count")).first()[0] or 0) > MOST:
        return None
    with dealt_out(scratch.spark, rows):
        given = right.select(piece_of("node", pieces).alias("piece"), "node", *[F.col(c).cast("double").alias(f"b{j}") for j, c in enumerate(names)])
        made = given.groupBy("piece").cogroup(both.groupBy("piece")).applyInPandas(lambda key, n, e: _made(key[0], n, e, width), MADE)
        made = scratch.table(made, "pieces")
        own, near = made.filter("kind = 'own'"), made.filter("kind LIKE 'near%'").select("kind", "piece", "other", "a")
        places = scratch.table(own.select("piece", "high", "a").groupBy("piece").cogroup(near.groupBy("piece")).applyInPandas(_places, MADE), "places")
        graphs = [made.union(places).filter(F.col("kind") == k).drop("kind").repartition(pieces, "piece").persist() for k in ("high", "low")]
        try:
            return _solved(scratch, own, *graphs, names, tol, rounds)
        finally:
            for graph in graphs:
                graph.unpersist()


def _solved(scratch: Scratch, own: DataFrame, high: DataFrame, low: DataFrame, names: list[str], tol: float, rounds: int) -> tuple[DataFrame, float] | None:
    width = len(names)
    sums = [f"{c}{j}" for c in "gde" for j in range(width)]
    held = f"piece int, degree binary, {', '.join(f'{v} binary' for v in VECTORS)}, {', '.join(f'{c} double' for c in sums)}"
    high, low = high.groupBy("piece"), low.groupBy("piece")
    mean, first = _moments(own, width)

    def back(sent: DataFrame):
        return low.cogroup(sent.groupBy("piece")).applyInPandas(lambda graph, sent: _sent_back(graph, sent, width), SENT).groupBy("piece")

    begun = own.select("piece", "high", "b", "d", "e")
    lows = begun.mapInPandas(lambda parts: (_lows(rows, mean) for rows in parts), SENT)
    begun = begun.groupBy("piece").cogroup(back(lows)).applyInPandas(lambda rows, sent: _begun(rows, sent, mean, sums), held)
    state = scratch.state(begun, "cg")
    # the steps of a round come from one sum over the vectors, as in System; 3 numbers a column go through the driver
    alpha, beta, gamma = np.zeros(width), np.zeros(width), np.zeros(width)
    for done in range(rounds + 1):
        sent = state.select("piece", "degree", "r", "s", "w").groupBy("piece").cogroup(high).applyInPandas(_sender(alpha, beta), SENT)
        new = state.select("piece", "degree", *VECTORS).groupBy("piece").cogroup(back(sent)).applyInPandas(_receiver(alpha, beta, sums), held)
        state = scratch.table(new, "cg", state)
        now, lower, left = np.array([v or 0.0 for v in state.agg(*[F.sum(c) for c in sums]).first()]).reshape(3, width)
        stop = left <= tol * tol * first
        if stop.all():
            break
        if done == rounds:
            scratch.drop(state)
            return None
        beta = np.divide(now, gamma, out=np.zeros(width), where=(gamma > 0) & ~stop)
        lower = lower - np.divide(beta * now, alpha, out=np.zeros(width), where=alpha > 0)
        alpha = np.divide(now, lower, out=np.zeros(width), where=(lower > 0) & ~stop)
        gamma = now
    worst = np.sqrt(np.divide(left, first, out=np.zeros(width), where=first > 0)).max()
    sent = state.select("piece", "x").groupBy("piece").cogroup(high).applyInPandas(lambda rows, graph: _sent(_numbers(rows["x"].iloc[0], width), graph), SENT)
    whole = own.select("piece", "high", "a", "c", "e").join(state.select("piece", "x"), "piece")
    x = whole.groupBy("piece").cogroup(sent.groupBy("piece")).applyInPandas(lambda rows, sent: _nodes(rows, sent, mean, names), "node long, " + ", ".join(f"`{c}` double" for c in names))
    x = scratch.table(x, "x")
    scratch.drop(state)
    middle = x.agg(*[F.avg(c) for c in names]).first()
    return x.select("node", *[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(names, middle, strict=True)]), float(worst)


def _moments(own: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The means of the right-hand sides over all nodes, and their squares less these."""

    def found(what) -> np.ndarray:
        def added(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in parts:
                for sides in rows[["d", "e"]].itertuples(index=False):
                    b = np.concatenate([_numbers(side, width) for side in sides])
                    yield pd.DataFrame([[float(len(b)), *what(b).sum(0)]])

        names = ["n", *[f"b{j}" for j in range(width)]]
        sums = own.select("d", "e").mapInPandas(lambda parts: (t.set_axis(names, axis=1) for t in added(parts)), ", ".join(f"{c} double" for c in names))
        return np.array([v or 0.0 for v in sums.agg(*map(F.sum, names)).first()])

    n, *sums = found(lambda b: b)
    mean = np.array(sums) / max(n, 1)
    return mean, found(lambda b: (b - mean) ** 2)[1:]


def _made(piece: int, right: pd.DataFrame, edges: pd.DataFrame, width: int) -> pd.DataFrame:
    """Rows of a piece. own: ids of its nodes, high ones first, and of high and low ones degrees and right-hand sides. high
    and low: for the edges of such nodes, in the order of the nodes that they reach, the place of its own node, where each
    of those nodes starts, where each piece of them does, the weights, if they aren't all 1, and the degrees of low nodes.
    near: the ids of the nodes that are so reached in a piece, for that piece."""
    names = [f.split()[0] for f in MADE.split(", ")]
    ids, far = np.unique(edges["far"].to_numpy(), return_inverse=True)
    if not len(ids):
        return pd.DataFrame(columns=names)
    near, other = edges["near"].to_numpy(), edges["other"].to_numpy()
    w = edges["w"].to_numpy(float) if "w" in edges else np.ones(len(far))
    degree = np.bincount(far, w, len(ids))
    b = np.zeros((len(ids), width))
    at = np.searchsorted(ids, right["node"].to_numpy())
    known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == right["node"].to_numpy())
    np.add.at(b, at[known], right[[f"b{j}" for j in range(width)]].fillna(0.0).to_numpy(float)[known])
    is_high = np.bincount(far, near < edges["far"].to_numpy(), len(ids)) > 0
    order = np.argsort(~is_high, kind="stable")
    high, place = int(is_high.sum()), np.empty(len(ids), np.int32)
    place[order] = np.arange(len(ids))
    degree, b = degree[order], b[order]
    rows = [("own", piece, -1, high, ids[order].tobytes(), degree[:high].tobytes(), degree[high:].tobytes(), b[:high].tobytes(), b[high:].tobytes())]
    for kind, mine, before in (("high", is_high[far], 0), ("low", ~is_high[far], high)):
        there, peer = near[mine], other[mine]
        by = np.lexsort((there, peer))
        there, peer, mine_at, weight = there[by], peer[by], place[far[mine][by]] - before, w[mine][by]
        starts = np.flatnonzero(np.append(True, there[1:] != there[:-1])[: len(there)])  # a node is in one piece: its edges follow each other
        peers, cuts = np.unique(peer[starts], return_index=True)
        ends = np.append(cuts, len(starts))[1:]
        arrays = (mine_at.astype(np.int32), starts.astype(np.int32), np.stack([peers, cuts, ends]).astype(np.int64))
        rows.append((kind, piece, -1, high, *(a.tobytes() for a in arrays), None if (weight == 1).all() else weight.tobytes(), degree[high:].tobytes()))
        rows += [(f"near {kind}", int(q), piece, 0, there[starts[i:j]].tobytes(), None, None, None, None) for q, i, j in zip(peers, cuts, ends, strict=True)]
    return pd.DataFrame(rows, columns=names)


def _places(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
    """For each piece that reaches this one the places of the nodes that it reaches, to be sent with their sums."""
    ids = np.frombuffer(own["a"].iloc[0], np.int64)
    order = np.argsort(ids)
    rows = []
    for kind, piece, other, a in near[["kind", "piece", "other", "a"]].itertuples(index=False):
        at = order[np.searchsorted(ids, np.frombuffer(a, np.int64), sorter=order)].astype(np.int32)
        rows.append((kind.removeprefix("near "), other, piece, 0, at.tobytes(), None, None, None, None))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in MADE.split(", ")])


def _sent(u: np.ndarray, graph: pd.DataFrame) -> pd.DataFrame:
    """For each piece that is reached from nodes of the values u: places there, and the sums for them."""
    own, places = graph[graph["other"] < 0].iloc[0], graph[graph["other"] >= 0]
    values = u[np.frombuffer(own["a"], np.int32)]
    if own["d"] is not None:
        values *= np.frombuffer(own["d"])[:, None]
    starts = np.frombuffer(own["b"], np.int32)
    values = np.add.reduceat(values, starts, axis=0) if len(starts) else values
    cuts = {q: slice(i, j) for q, i, j in np.frombuffer(own["c"], np.int64).reshape(3, -1).T}
    rows = [(q, at, values[cuts[q]].tobytes()) for q, at in zip(places["other"], places["a"], strict=True)]
    return pd.DataFrame(rows, columns=["piece", "at", "sums"])


def _summed(sent: pd.DataFrame, nodes: int, width: int) -> np.ndarray:
    """What was sent to so many nodes of a piece; without places it is for all of them."""
    y = np.zeros((nodes, width))
    for at, values in zip(sent["at"], sent["sums"], strict=True):
        if at is None:
            y += _numbers(values, width)
        else:
            y[np.frombuffer(at, np.int32)] += _numbers(values, width)  # a node is once in each of them
    return y


def _sent_back(graph: pd.DataFrame, sent: pd.DataFrame, width: int) -> pd.DataFrame:
    """What low nodes give to high ones after they were sent their sums, and what was sent to high ones of this piece."""
    own = graph[graph["other"] < 0].iloc[0]
    high, degree = own["high"], np.frombuffer(own["e"])[:, None]
    y = _summed(sent, high + len(degree), width)
    found = _sent(y[high:] / degree, graph)
    if y[:high].any():
        found = pd.concat([found, pd.DataFrame({"piece": [own["piece"]], "at": [None], "sums": [y[:high].tobytes()]})])
    return found


def _lows(rows: pd.DataFrame, mean: np.ndarray) -> pd.DataFrame:
    """The right-hand sides of low nodes, as if sent to them."""
    sums = [np.concatenate([np.zeros((high, len(mean))), _numbers(e, len(mean)) - mean]).tobytes() for high, e in zip(rows["high"], rows["e"], strict=True)]
    return pd.DataFrame({"piece": rows["piece"], "at": None, "sums": sums})


def _begun(rows: pd.DataFrame, sent: pd.DataFrame, mean: np.ndarray, sums: list[str]) -> pd.DataFrame:
    """Vectors at the start: the residual is the right-hand side of S, the others are 0."""
    (row,) = rows.itertuples(index=False)
    b = _numbers(row.d, len(mean)) - mean
    vectors = {v: [bytes(b.nbytes)] for v in VECTORS} | {"r": [(b + _summed(sent, len(b), len(mean))).tobytes()]}
    return pd.DataFrame({"piece": [row.piece], "degree": [row.b]} | vectors | {c: [0.0] for c in sums})


def _sender(alpha: np.ndarray, beta: np.ndarray):
    """What high nodes give after a step."""

    def sent(state: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        (row,) = state.itertuples(index=False)
        r, s, w = (_numbers(v, len(alpha)) for v in (row.r, row.s, row.w))
        return _sent((r - alpha * (w + beta * s)) / np.frombuffer(row.degree)[:, None], graph)

    return sent


def _receiver(alpha: np.ndarray, beta: np.ndarray, sums: list[str]):
    """A piece's vectors after a step, with w = S u from what was sent back to it, and its shares of the sums."""

    def received(state: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        (row,) = state.itertuples(index=False)
        x, r, p, s, w = (_numbers(getattr(row, v), len(alpha)) for v in VECTORS)
        degree = np.frombuffer(row.degree)[:, None]
        p, s = r / degree + beta * p, w + beta * s
        x, r = x + alpha * p, r - alpha * s
        u = r / degree
        w = r - _summed(sent, len(u), len(alpha))
        shares = np.concatenate([(r * u).sum(0), (w * u).sum(0), (r * r).sum(0)])
        kept = {"piece": [row.piece], "degree": [row.degree]} | {v: [a.tobytes()] for v, a in zip(VECTORS, (x, r, p, s, w), strict=True)}
        return pd.DataFrame(kept | {c: [v] for c, v in zip(sums, shares, strict=True)})

    return received


def _nodes(rows: pd.DataFrame, sent: pd.DataFrame, mean: np.ndarray, names: list[str]) -> pd.DataFrame:
    """Solutions at high nodes, and from what these give at low ones."""
    (row,), width = rows.itertuples(index=False), len(mean)
    x, degree = _numbers(row.x, width), np.frombuffer(row.c)[:, None]
    low = (_numbers(row.e, width) - mean + _summed(sent, row.high + len(degree), width)[row.high :]) / degree
    x = np.concatenate([x, low])
    return pd.DataFrame({"node": np.frombuffer(row.a, np.int64)} | {c: x[:, j] for j, c in enumerate(names)})


def _numbers(found: bytes, width: int) -> np.ndarray:
    return np.frombuffer(found).reshape(-1, width)
