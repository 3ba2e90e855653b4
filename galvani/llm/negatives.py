"""Hard negatives by dual-tree search: one tree over the anchors, one over all rows, and intervals of inner products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bound_batches, placed

#: Vectors of a block (a node above the leaves, held by one task at a time), of a leaf, and nodes of a higher node.
BLOCK, ANCHOR_BLOCK, LEAF, ANCHOR_LEAF, FAN = 4096, 1024, 128, 32, 16
#: Bytes of a block, which has fewer vectors where these are long.
BLOCK_BYTES = 8_000_000
#: Vectors, chosen by a hash, that the order of a tree is fitted on (every row is placed by it), and cells of the order.
SAMPLE, CELLS = 4096, 64
#: Positives of an anchor and negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: Whole numbers up to here are exact in float64; beyond, inner products are taken in Python's integers.
EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1

ROWS = "vec_id long, label int, x array<double>"
NODE = "node long, n int, low int, high int, center array<double>, radius double, norm double, payload binary"


# --- vectors and leaves inside a task -----------------------------------------------------------------------------------


def _matrix(vectors) -> np.ndarray:
    """A row for each vector, zeros past its end."""
    wide = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), wide))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, wide - m.shape[1]))) if m.shape[1] < wide else m for m in (a, b))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly; those beyond 64 bits are held at its ends."""
    a, b = _alike(a, b)
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = [[[int(v) for v in row] for row in m] for m in (a, b)]
    return np.array([[min(_MOST, max(_LEAST, sum(x * y for x, y in zip(u, v, strict=True)))) for v in ints[1]] for u in ints[0]], np.int64).reshape(len(a), len(b))


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    center = x.mean(0)
    return center, float(np.sqrt(((x - center) ** 2).sum(1).max(initial=0)))


def _bisected(x: np.ndarray, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The rows in leaves: halves along the line between two far rows, again and again."""
    done, todo = [], [rows]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            done.append(own)
            continue
        v = x[own]
        a = v[np.argmax(((v - v[0]) ** 2).sum(1))]
        b = v[np.argmax(((v - a) ** 2).sum(1))]
        order = np.argsort(v @ (b - a), kind="stable")
        todo += [own[order[len(own) // 2 :]], own[order[: len(own) // 2]]]
    return done


class Block:
    """Vectors with their ids and labels, leaf by leaf, and each leaf's ball and range of labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int):
        parts = _bisected(x, np.arange(len(ids)), leaf)
        order = np.concatenate(parts)
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.cuts = np.cumsum([0] + [len(p) for p in parts])
        self._measure()

    def _measure(self) -> None:
        balls = [_ball(self.x[a:b]) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.centers, self.radii = np.array([c for c, _ in balls]), np.array([r for _, r in balls])
        self.low, self.high = np.minimum.reduceat(self.labels, self.cuts[:-1]), np.maximum.reduceat(self.labels, self.cuts[:-1])

    def packed(self) -> bytes:
        """Components as the least kind of number that holds them."""
        most = np.abs(self.x).max(initial=0)
        kind = next((k for k, m in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1)) if most <= m), "f8")
        head = np.array([len(self.ids), self.x.shape[1], len(self.cuts), ["i1", "i2", "i4", "f8"].index(kind)], np.int64)
        return b"".join(v.tobytes() for v in (head, self.ids, self.labels.astype(np.int32), self.cuts.astype(np.int32), self.x.astype(kind)))

    @classmethod
    def of(cls, data: bytes) -> Block:
        n, wide, cuts, kind = np.frombuffer(data, np.int64, 4)
        out, at = cls.__new__(cls), 32
        out.ids, at = np.frombuffer(data, np.int64, n, at), at + 8 * n
        out.labels, at = np.frombuffer(data, np.int32, n, at), at + 4 * n
        out.cuts, at = np.frombuffer(data, np.int32, cuts, at), at + 4 * cuts
        out.x = np.frombuffer(data, ("i1", "i2", "i4", "f8")[kind], n * wide, at).reshape(n, wide).astype(float)
        out._measure()
        return out


def intervals(ca: np.ndarray, ra: np.ndarray, cb: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that an inner product of any row of one ball with any of the other can be, for all pairs of balls."""
    ca, cb = _alike(ca, cb)
    middle, na, nb = ca @ cb.T, np.sqrt((ca**2).sum(1))[:, None], np.sqrt((cb**2).sum(1))[None]
    ra, rb = ra[:, None], rb[None]
    reach = na * rb + nb * ra + ra * rb
    slack = 1 + 1e-9 * (np.abs(middle) + na * nb + reach)  # of rounding
    return middle - reach - slack, middle + reach + slack


# --- the trees ----------------------------------------------------------------------------------------------------------


def _order(rows: DataFrame) -> list[np.ndarray]:
    """Centres of at most CELLS cells, near ones beside each other, fitted on SAMPLE rows."""
    drawn = [r["x"] for r in rows.select("x").orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).collect()]
    x = _matrix(drawn)
    return [x[part].mean(0) for part in _bisected(x, np.arange(len(x)), max(1, -(-len(x) // CELLS)))] if len(x) else []


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    x, centers = _alike(x, centers)
    return np.argmin((centers**2).sum(1)[None] - 2 * x @ centers.T, 1)


class Tree:
    """Levels of nodes over rows (vec_id, label, x): level 0 are blocks with their vectors, the last is one root.

    Rows are ordered by cell, label and id, dealt out by ranges of this order, and cut into blocks; a block's leaves are
    made inside its task. FAN neighbours share a parent. No task holds more than a block at once.
    """

    def __init__(self, rows: DataFrame, scratch: Scratch, block: int, leaf: int):
        self.scratch = scratch
        centers = _order(rows)
        cells = _matrix(centers)

        def place(batches):
            for batch in batches:
                yield batch.assign(cell=_nearest(_matrix(batch["x"].tolist()), cells).astype(np.int32) if len(centers) else 0)

        def cut(batches):
            held: list[pd.DataFrame] = []
            count = size = 0
            for batch in batches:
                for k in range(0, len(batch), min(block, 128)):
                    held.append(batch.iloc[k : k + min(block, 128)])
                    count += len(held[-1])
                    size += sum(8 * len(v) for v in held[-1]["x"])
                    if count >= block or size >= BLOCK_BYTES:
                        yield packed(held)
                        held, count, size = [], 0, 0
            if held:
                yield packed(held)

        def packed(held):
            df = pd.concat(held)
            made = Block(df["vec_id"].to_numpy(np.int64), df["label"].to_numpy(np.int32), _matrix(df["x"].tolist()), leaf)
            center, radius = _ball(made.x)
            return pd.DataFrame({"first": [int(df["cell"].iloc[0])], "low": [made.low.min()], "high": [made.high.max()], "least": [int(df["vec_id"].min())], "n": [len(df)], "center": [center], "radius": [radius], "payload": [made.packed()]})

        count = rows.count()
        order = ["cell", "label", "vec_id"]
        dealt = rows.mapInPandas(place, f"{ROWS}, cell int").repartitionByRange(max(1, count // (4 * block)), *order).sortWithinPartitions(*order)
        blocks = scratch.table(dealt.mapInPandas(cut, "first int, low int, high int, least long, n int, center array<double>, radius double, payload binary"), "blocks")
        ids = placed(blocks.select("first", "low", "least", "n", F.lit(1).cast("long").alias("one"), F.xxhash64("payload").alias("tie")), ["first", "low", "least", "tie"], "one", scratch)
        same = [F.col(f"b.{c}") == F.col(f"i.{c}") for c in ("first", "low", "least", "n")] + [F.xxhash64("b.payload") == F.col("i.tie")]
        named = blocks.alias("b").join(ids.alias("i"), same).select(F.col("i.before").alias("node"), *[f"b.{c}" for c in ("n", "low", "high", "center", "radius", "payload")])
        self.levels = [scratch.table(named, "nodes")]
        self.sizes = [self.levels[0].count()]
        while self.sizes[-1] > 1:
            self.levels.append(scratch.table(self._above(self.levels[-1]), "nodes"))
            self.sizes.append(-(-self.sizes[-1] // FAN))

    def _above(self, below: DataFrame) -> DataFrame:
        def run(df: pd.DataFrame) -> pd.DataFrame:
            x = _matrix(df["center"].tolist())
            center = np.average(x, axis=0, weights=df["n"])
            radius = (np.sqrt(((x - center) ** 2).sum(1)) + df["radius"]).max()
            return pd.DataFrame({"node": [df["node"].iloc[0] // FAN], "n": [df["n"].clip(upper=2**20).sum()], "low": [df["low"].min()], "high": [df["high"].max()], "center": [center], "radius": [radius * (1 + 1e-12)]})

        return below.drop("payload").groupBy(F.floor(F.col("node") / FAN).alias("up")).applyInPandas(run, "node long, n int, low int, high int, center array<double>, radius double")

    def level(self, k: int) -> DataFrame:
        """Nodes of a level; above the root the root again."""
        return self.levels[min(k, len(self.levels) - 1)].drop("payload")


# --- the search ---------------------------------------------------------------------------------------------------------


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _norm(a: str):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


class Search:
    """Anchors against all rows, over the pairs of nodes whose intervals can still hold a wanted inner product.

    A search first scores each block of anchors with the block of rows that promises most (`home`), so that every anchor
    has a bound; bounds go up the anchors' tree, and pairs of nodes come down both trees by joins with the children, as
    long as their interval meets what any anchor below still wants: whole groups of anchors are given up at once. What
    is left are pairs of blocks; their tasks do the same with the leaves, and score pairs of leaves exactly.
    """

    def __init__(self, anchors: DataFrame, rows: DataFrame, scratch: Scratch, **sizes: int):
        self.scratch = scratch
        self.left = Tree(anchors, scratch, sizes.get("anchor_block", ANCHOR_BLOCK), sizes.get("anchor_leaf", ANCHOR_LEAF))
        self.right = Tree(rows, scratch, sizes.get("block", BLOCK), sizes.get("leaf", LEAF))
        self.scored: dict[str, int] = {}
        self.home = scratch.table(self._home(), "home")

    def _home(self) -> DataFrame:
        """a, c: for each block of anchors the block of rows in whose ball its centre lies deepest; found by going down
        the rows' tree to the child that is nearest."""
        at = self.left.level(0).select(F.col("node").alias("a"), "center", F.lit(0).cast("long").alias("c"))
        for k in range(len(self.right.levels) - 2, -1, -1):
            below = self.right.level(k).select(F.floor(F.col("node") / FAN).alias("c"), F.col("node").alias("child"), F.col("center").alias("there"))
            gap = _dot("there", "there") - 2 * _dot("center", "there")
            at = at.join(below, "c").groupBy("a").agg(F.min_by(F.struct("center", F.col("child").alias("c")), F.struct(gap, F.col("child"))).alias("best")).select("a", "best.center", "best.c")
        return at.select("a", "c")

    def _wanted(self, bounds: DataFrame) -> list[DataFrame]:
        """For each level of the anchors' tree node, lo, hi: the hull of what the anchors below want."""
        out = [bounds.groupBy(F.col("a").alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))]
        for _ in self.left.levels[1:]:
            out.append(out[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        return out

    def pairs(self, bounds: DataFrame, same_label: bool) -> DataFrame:
        """a, c of the pairs of blocks, but for home, whose interval meets the wanted one."""
        wanted = self._wanted(bounds)
        top = max(len(self.left.levels), len(self.right.levels)) - 1
        found = self.left.level(top).select(F.col("node").alias("a")).join(self.right.level(top).select(F.col("node").alias("c")), F.col("a") == F.col("c"))  # the roots
        for k in range(top, -1, -1):
            if k < top:
                up = lambda tree, name: tree.level(k).select((F.floor(F.col("node") / FAN) if k + 1 < len(tree.levels) else F.col("node")).alias(name), F.col("node").alias(f"{name}_child"))  # noqa: B023, E731
                found = found.join(up(self.left, "a"), "a").join(up(self.right, "c"), "c").select(F.col("a_child").alias("a"), F.col("c_child").alias("c"))
            mine = self.left.level(k).join(wanted[min(k, len(wanted) - 1)], "node").selectExpr("node AS a", "low AS al", "high AS ah", "center AS ax", "radius AS ar", "lo", "hi")
            theirs = self.right.level(k).selectExpr("node AS c", "low AS cl", "high AS ch", "center AS cx", "radius AS cr")
            both = found.join(mine, "a").join(theirs, "c").withColumn("middle", _dot("ax", "cx")).withColumn("na", _norm("ax")).withColumn("nc", _norm("cx"))
            both = both.withColumn("reach", F.expr("na * cr + nc * ar + ar * cr")).withColumn("slack", F.expr("1 + 1e-9 * (abs(middle) + na * nc + reach)"))
            fits = "middle + reach + slack >= lo AND middle - reach - slack <= hi AND " + ("al <= ch AND cl <= ah" if same_label else "NOT (al = ah AND cl = ch AND al = cl)")
            found = self.scratch.table(both.filter(fits).select("a", "c"), "pairs")
        return found.join(self.home, ["a", "c"], "left_anti")

    def score(self, pairs: DataFrame, per_block: DataFrame, run, schema: str) -> DataFrame:
        """run(anchors' block, its own row of per_block, rows' block) for each pair of blocks."""
        mine = self.left.levels[0].select(F.col("node").alias("a"), F.col("payload").alias("left")).join(per_block, "a", "left")
        theirs = self.right.levels[0].select(F.col("node").alias("c"), F.col("payload").alias("right"))

        def each(batches):
            for batch in batches:
                for row in batch.itertuples(index=False):
                    out = run(Block.of(row.left), row.wants, Block.of(row.right))
                    yield out.assign(a=row.a)

        joined = pairs.join(mine, "a").join(theirs, "c").select("a", "left", "wants", "right")
        return self.scratch.table(joined.mapInPandas(each, f"{schema}, a long"), "scored")


def _top(ids: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Places of the first by score, then id."""
    if len(value) > 4 * most:
        kept = np.flatnonzero(value >= np.partition(value, len(value) - most)[len(value) - most])
        return kept[np.lexsort((ids[kept], -value[kept]))[:most]]
    return np.lexsort((ids, -value))[:most]


def _leaf_pairs(left: Block, right: Block, lo: np.ndarray, hi: np.ndarray, same: bool):
    """For each leaf of anchors the leaves of rows whose interval meets what one of its anchors wants."""
    least, most = intervals(left.centers, left.radii, right.centers, right.radii)
    for k, (a, b) in enumerate(zip(left.cuts, left.cuts[1:], strict=False)):
        fits = (most[k] >= lo[a:b].min()) & (least[k] <= hi[a:b].max())
        if same:
            fits &= (left.low[k] <= right.high) & (right.low <= left.high[k])
        elif left.low[k] == left.high[k]:
            fits &= ~((right.low == right.high) & (right.low == left.low[k]))
        yield a, b, np.flatnonzero(fits)


def _rows_of(right: Block, leaves: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(right.cuts[j], right.cuts[j + 1]) for j in leaves]) if len(leaves) else np.zeros(0, np.int64)


_POSITIVE = "anchor_id long, vec_id long, score long"
_NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(most: int):
    def run(left: Block, wants, right: Block) -> pd.DataFrame:
        # wants: anchor and least score, where other blocks gave enough rows already
        floor = dict(zip(*(np.frombuffer(w, np.int64) for w in wants), strict=True)) if wants is not None else {}
        lo = np.array([floor.get(i, _LEAST) for i in left.ids.tolist()], float)
        out = []
        for a, b, leaves in _leaf_pairs(left, right, lo, np.full(len(lo), np.inf), True):
            at = _rows_of(right, leaves)
            value = scores(left.x[a:b], right.x[at]) if len(at) else None
            for k in range(a, b) if len(at) else ():
                ok = np.flatnonzero((right.labels[at] == left.labels[k]) & (right.ids[at] != left.ids[k]) & (value[k - a] >= lo[k]))
                top = ok[_top(right.ids[at][ok], value[k - a][ok], most)]
                out.append((np.full(len(top), left.ids[k]), right.ids[at][top], value[k - a][top]))
        return pd.DataFrame(dict(zip(("anchor_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)) if out else {c: np.zeros(0, np.int64) for c in ("anchor_id", "vec_id", "score")})

    return run


def _negatives(most: int):
    def run(left: Block, wants, right: Block) -> pd.DataFrame:
        # wants: anchor, positive, its score, and the least and most that its negatives may have
        anchor, positive, value_p, low, high = (np.frombuffer(w, np.int64) for w in wants)
        order = np.argsort(anchor, kind="stable")
        begin, end = np.searchsorted(anchor[order], left.ids, "left"), np.searchsorted(anchor[order], left.ids, "right")
        lo, hi = np.full(len(left.ids), np.inf), np.full(len(left.ids), -np.inf)
        for k, (p, q) in enumerate(zip(begin, end, strict=True)):
            if q > p:
                lo[k], hi[k] = low[order[p:q]].min(), high[order[p:q]].max()
        out = []
        for a, b, leaves in _leaf_pairs(left, right, lo, hi, False):
            at = _rows_of(right, leaves)
            value = scores(left.x[a:b], right.x[at]) if len(at) else None
            for k in range(a, b) if len(at) else ():
                other = np.flatnonzero(right.labels[at] != left.labels[k])
                for p in order[begin[k] : end[k]]:
                    ok = other[(value[k - a][other] >= low[p]) & (value[k - a][other] <= high[p])]
                    top = ok[_top(right.ids[at][ok], value[k - a][ok], most)]
                    out.append((np.full(len(top), left.ids[k]), np.full(len(top), positive[p]), np.full(len(top), value_p[p]), right.ids[at][top], value[k - a][top]))
        names = [c.split()[0] for c in _NEGATIVE.split(", ")]
        return pd.DataFrame(dict(zip(names, (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)) if out else {c: np.zeros(0, np.int64) for c in names})

    return run


def _packed_rows(names: list[str]):
    """A block's rows as columns of 64-bit numbers, in one row."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": [df["a"].iloc[0]], "wants": [[df[c].to_numpy(np.int64).tobytes() for c in names]]})

    return run, "a long, wants array<binary>"


def _first(rows: DataFrame, by: list[str], value: str, row_id: str, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), row_id))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


def known_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, x of the rows that take part: no null id or label, no null or non-finite component; components
    floor(256 x) as whole numbers; where 7 divides the id the label is (label + 1) % 10. Repeated rows count once, and
    of rows with one id that with the least label and vector counts."""
    bound_batches(vectors.sparkSession)
    x = vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("int").alias("label"), x.alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(fine)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    scaled = F.transform("x", lambda v: _whole(v))
    return rows.select("vec_id", label.alias("label"), scaled.alias("x")).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("v")).select("vec_id", "v.label", "v.x")


def _whole(v):
    """floor(256 v) as a double; from 2^52 on any double is whole, and floor() gives 64 bits only."""
    y = v * 256.0
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)


def mine_negatives(vectors: DataFrame, anchors: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", **sizes: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives of an anchor (a row that meets the condition) are its first `positives` other rows of its label by inner
    product, ties by smaller id; negatives of a positive the first rows of other labels whose score is 50 to 95 % of
    the positive's. Every row is in the tree and every interval is a true bound, so results are exact. Vectors of
    different lengths are filled up with zeros; what takes no part is told at known_vectors. Empty tables, or ones
    without anchors, give an empty result; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.table(known_vectors(vectors, id_col, label_col, vector_col), "vectors")
    search = Search(rows.filter(anchors), rows, scratch, **sizes)

    nothing = scratch.spark.createDataFrame([], "a long, wants array<binary>")
    first = search.score(search.home, nothing, _positives(positives), _POSITIVE)
    home = _first(first, ["a", "anchor_id"], "score", "vec_id", positives)
    every = search.left.levels[0].select(F.col("node").alias("a"), "n")
    enough = home.filter(F.col("rank") == positives).select("a", "anchor_id", F.col("score").alias("least"))
    sure = every.join(enough, "a", "left").groupBy("a").agg(F.count("anchor_id").alias("known"), F.max("n").alias("n"), F.min("least").alias("least"))
    bounds = sure.select("a", F.when(F.col("known") == F.col("n"), F.col("least").cast("double")).otherwise(F.lit(float("-inf"))).alias("lo"), F.lit(float("inf")).alias("hi"))
    pack, schema = _packed_rows(["anchor_id", "least"])
    more = search.score(search.pairs(bounds, True), enough.groupBy("a").applyInPandas(pack, schema), _positives(positives), _POSITIVE)
    found = scratch.table(_first(first.unionByName(more), ["a", "anchor_id"], "score", "vec_id", positives).select("a", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the least and the most that 50 p <= 100 n <= 95 p leaves, without products that could pass 64 bits
    wanted = found.withColumn("low", F.expr("shiftright(positive_score, 1) + (positive_score & 1)")).withColumn("high", F.expr("positive_score - (positive_score div 20) - int(positive_score % 20 > 0)")).filter("low <= high")
    wanted = scratch.table(wanted, "wanted")
    names = ["anchor_id", "positive_id", "positive_score", "low", "high"]
    pack, schema = _packed_rows(names)
    first = search.score(search.home.join(wanted.select("a").distinct(), "a", "left_semi"), wanted.groupBy("a").applyInPandas(pack, schema), _negatives(negatives), _NEGATIVE)
    by = ["a", "anchor_id", "positive_id"]
    home = _first(first, by, "negative_score", "negative_id", negatives)
    third = home.filter(F.col("rank") == negatives).select(*by, F.col("negative_score").alias("third"))
    wanted = wanted.join(third, by, "left").withColumn("low", F.greatest("low", F.coalesce("third", "low"))).drop("third")
    bounds = wanted.select("a", F.col("low").cast("double").alias("lo"), F.col("high").cast("double").alias("hi"))
    more = search.score(search.pairs(bounds, False), wanted.groupBy("a").applyInPandas(pack, schema), _negatives(negatives), _NEGATIVE)
    best = _first(first.unionByName(more), by, "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
