import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galvani.functions.noise import projections
from galvani.operators import bridges as B
from galvani.operators import centrality as C
from galvani.operators import classes as L
from galvani.operators import components as K
from galvani.operators import decomposition as D
from galvani.operators import edges as E
from galvani.operators import parts as Q
from galvani.operators import paths as P
from galvani.operators import resistance as R
from galvani.operators import selected as Z
from galvani.operators import solve as V
from galvani.operators import trees as T
from galvani.sources import edge_lists as S
from galvani.sources import scratch as scratch_module
from galvani.sources.scratch import Scratch
from graphs import KNOWN, PATH7, TEST18, TEST18_FARNESS, TRIANGLE, edge_table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def scratch(spark):
    return Scratch(spark)


def test_edge_lists_are_read_as_written(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\n1 2\n2\t1 7\n 3 3\nx y\n\n2 3\n")
    (tmp_path / "b.txt").write_text("5 6\n")
    edges, nodes = S.read_edge_list(spark, str(tmp_path / "a.txt"))
    assert rows(edges) == [(1, 2), (2, 3)] and rows(nodes) == [(1,), (2,), (3,)]
    edges, nodes = S.read_edge_lists(spark, str(tmp_path))
    assert rows(edges) == [("a.txt", 1, 2), ("a.txt", 2, 3), ("b.txt", 5, 6)]
    assert rows(S.rejected_lines(spark, str(tmp_path / "a.txt"))) == [("x y", 1)]
    for k, part in enumerate(("a+b c", "a=1")):
        (tmp_path / "deep" / part).mkdir(parents=True)
        (tmp_path / "deep" / part / "same.txt").write_text(f"{k} 9\n")
        (tmp_path / "deep" / part / ".hidden").write_text("7 8\n")
    assert rows(S.read_edge_lists(spark, str(tmp_path / "deep"))[0]) == [("a+b c/same.txt", 0, 9), ("a=1/same.txt", 1, 9)]
    assert rows(S.read_edge_lists(spark, str(tmp_path / "deep"), by="folder")[0]) == [("a+b c", 0, 9), ("a=1", 1, 9)]
    assert rows(S.path_graph(spark, 4)) == [(1, 2), (2, 3), (3, 4)] and rows(S.path_graph(spark, 1)) == []
    lone = spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")
    assert rows(S.canonical(lone, "u", "v")) == [] and rows(S.nodes_of(lone, "u", "v")) == [(1,), (2,)]


def test_rows_of_the_laplacian_sum_to_zero(spark):
    edges = edge_table(spark, TEST18)
    sums = E.laplacian(edges).groupBy("i").agg(F.sum("val").alias("s"))
    assert all(r["s"] == 0 for r in sums.collect())
    assert rows(E.size(edges)) == [(18, 24)]
    ones = E.nodes(edges).withColumn("value", F.lit(1.0))
    assert all(r["value"] == 0 for r in E.laplacian_times(edges, ones).collect())


def test_dense_ids_follow_the_order(spark):
    pairs = spark.createDataFrame([(0, 7, 5), (1, 5, 9), (2, 3, 7)], "p long, a long, b long")
    assert rows(E.first_appearance_ids(pairs, "a", "b", "p")) == [(3, 4), (5, 2), (7, 1), (9, 3)]


def test_components_against_brute_force(spark, scratch):
    rng = random.Random(3)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(99, 99), (7, None)]
    label = {x: x for p in pairs if None not in p for x in p}
    for _ in label:
        for a, b in pairs:
            if b is not None:
                label[a] = label[b] = min(label[a], label[b])
    found = K.connected_components(spark.createDataFrame(pairs, "a long, b long"), scratch.table)
    assert dict(rows(found)) == label
    assert rows(K.connected_components(spark.createDataFrame([], "a long, b long"), scratch.table)) == []


def test_a_long_path_is_one_component(spark, scratch):
    found = K.connected_components(S.path_graph(spark, 300), scratch.table)
    assert found.count() == 300 and found.select("component").distinct().collect()[0][0] == 1


@pytest.mark.parametrize("name", KNOWN)
def test_known_centralities(spark, name):
    edges, n, node, value, trace = KNOWN[name]
    matrix = R.pseudo_inverse(edge_table(spark, edges)).cache()
    assert R.trace(matrix).first()[0] == pytest.approx(trace, abs=1e-6)
    table = C.with_centrality(R.farness_of_diagonal(R.diagonal(matrix)))
    top = C.top_nodes(table, "centrality", 1).first()
    assert top["node"] == node and top["centrality"] == pytest.approx(value, abs=1e-6) and table.count() == n
    foster = R.pair_resistance(matrix, edge_table(spark, edges)).agg(F.sum("r")).first()[0]
    assert foster == pytest.approx(n - 1)
    matrix.unpersist()


def test_resistance_on_a_tree_is_the_distance(spark):
    pairs = R.all_pairs_resistance(R.pseudo_inverse(edge_table(spark, PATH7)))
    assert all(r["r"] == pytest.approx(r["v"] - r["u"]) for r in pairs.collect())


def test_bridges_blocks_and_decomposition(spark, scratch):
    edges = scratch.table(edge_table(spark, TEST18))
    bridges = scratch.table(B.classify_bridges(edges, B.find_bridges(edges, scratch)))
    assert rows(bridges) == [(1, 14, "leaf"), (1, 15, "leaf"), (2, 10, "inner"), (7, 8, "leaf"), (12, 13, "inner"), (17, 18, "leaf")]
    profile = {r["block"]: (r["nodes"], r["real_size"]) for r in B.block_profile(B.blocks(edges, bridges, scratch)).collect()}
    assert profile == {1: (8, 11), 10: (3, 3), 13: (3, 4)}
    found = dict(rows(D.decomposed_farness(edges, bridges, scratch)))
    assert [found[i] for i in range(1, 19)] == pytest.approx(TEST18_FARNESS, abs=1e-6)


def test_no_bridges_in_a_cycle(spark, scratch):
    edges = edge_table(spark, TRIANGLE)
    assert rows(B.find_bridges(edges, scratch)) == []
    assert rows(B.bridge_statistics(edges, B.classify_bridges(edges, B.find_bridges(edges, scratch)))) == [(0.0, 0.0, 0.0, 0.0, 0.0)]


def test_greedy_group(spark, scratch):
    ranked, value = C.exact_greedy(edge_table(spark, TEST18), 3, scratch)
    assert [r["node"] for r in ranked.filter("rank = 1").orderBy("step").collect()] == [2, 17, 7]
    assert value.first()["centrality"] == pytest.approx(1.529103, abs=1e-6)
    given = C.exact_greedy(edge_table(spark, TEST18), 2, scratch, given=[2, 17])[1]
    assert given.first()["centrality"] == pytest.approx(1.118895, abs=1e-6)
    with pytest.raises(ValueError):
        C.exact_greedy(edge_table(spark, TEST18), 2, scratch, given=[2])


@pytest.mark.parametrize("plan", ["columns", "tables"])
def test_profiles_of_inverses(spark, scratch, plan):
    ids, lap = dense(TEST18)
    for ground in ((), (2, 13)):
        keep = [k for k, n in enumerate(ids) if n not in ground]
        inverse = np.linalg.inv(lap[np.ix_(keep, keep)]) if ground else np.linalg.pinv(lap)
        found = {r["node"]: (r["own"], r["square"]) for r in V.System(edge_table(spark, TEST18), scratch, ground, plan).profile().collect()}
        assert found == pytest.approx({ids[k]: pytest.approx((inverse[i, i], (inverse @ inverse)[i, i]), abs=1e-8) for i, k in enumerate(keep)})


def test_greedy_by_updates(spark, scratch):
    """Without the table of the inverse the same scores, ranks and value come out."""
    edges = scratch.table(edge_table(spark, TEST18))
    (a, va), (b, vb) = (C.exact_greedy(edges, 4, scratch, most=most) for most in (4096, 0))
    score = {(r["step"], r["node"]): r["score"] for r in a.collect()}
    assert {(r["step"], r["node"]): r["score"] for r in b.collect()} == pytest.approx(score, abs=1e-8)
    assert rows(a.filter("rank = 1").select("step", "node")) == rows(b.filter("rank = 1").select("step", "node"))
    assert vb.first()["centrality"] == pytest.approx(va.first()["centrality"], abs=1e-8)


def test_sketches_are_brought_forward(spark, scratch):
    """Projections after two nodes were grounded are those that the same signs give if solved for anew."""
    edges = scratch.table(edge_table(spark, TEST18))
    sketches = C.Sketches(edges, 5, 3, scratch)
    for node in (2, 17):
        sketches.ground(node)
    right = sketches.right.filter("node not in (2, 17)")
    want = {(r["block"], r["node"]): [r[f"x{j}"] for j in range(8)] for r in V.System(edges, scratch, (2, 17)).solve(right, 1e-12)[0].collect()}
    found = {(r["block"], r["node"]): [r[f"x{j}"] for j in range(8)] for r in sketches.state.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    picks = [r["node"] for r in C.estimated_greedy(edges, 3, scratch, 100)[0].filter("rank = 1").orderBy("step").collect()]
    assert picks[0] == 2 and len(set(picks)) == 3


def dense(pairs):
    ids = sorted({n for e in pairs for n in e})
    lap = np.zeros((len(ids), len(ids)))
    for u, v in pairs:
        i, j = ids.index(u), ids.index(v)
        lap[i, j] = lap[j, i] = -1
    return ids, lap - np.diag(lap.sum(1))


@pytest.mark.parametrize("ground", [(), (2,), (2, 13)])
@pytest.mark.parametrize("plan,reduce", [("tables", True), ("tables", False), ("columns", True), ("columns", False)])
def test_solutions_against_dense_ones(spark, scratch, ground, plan, reduce):
    ids, lap = dense(TEST18)
    keep = [k for k, n in enumerate(ids) if n not in ground]
    random = np.random.default_rng(1)
    b = random.normal(size=(len(keep), 3))
    right = spark.createDataFrame([(int(ids[k]), *map(float, row)) for k, row in zip(keep, b, strict=True)], "node long, p double, q double, r double")
    x, residual = V.solve_by_shuffle(edge_table(spark, TEST18), right, ["p", "q", "r"], scratch, tol=1e-10, ground=ground, plan=plan, reduce=reduce)
    want = np.linalg.solve(lap[np.ix_(keep, keep)], b) if ground else np.linalg.pinv(lap) @ b
    found = {r["node"]: (r["p"], r["q"], r["r"]) for r in x.collect()}
    assert residual <= 1e-10 and sorted(found) == sorted(ids[k] for k in keep)
    for k, row in zip(keep, want, strict=True):
        assert found[ids[k]] == pytest.approx(tuple(row), abs=1e-6)
    with pytest.raises(ArithmeticError):
        V.solve_by_shuffle(edge_table(spark, TEST18), right, ["p"], scratch, tol=1e-10, rounds=1, ground=ground, plan=plan, reduce=False)


def test_leaves_and_chains_are_eliminated(spark, scratch):
    """A weighted graph of a dense core with long chains, stars and rings on it, grounded and not, and a tree."""
    rng = np.random.default_rng(4)
    core = [(i, j, float(rng.uniform(0.5, 2))) for i in range(8) for j in range(i)]
    chains = [(8 + k, 9 + k, 1.5) for k in range(80)] + [(0, 8, 1.0), (88, 3, 2.0)]
    stars = [(5, 200 + k, float(1 + k % 3)) for k in range(60)] + [(260, 261, 1.0), (261, 262, 1.0), (260, 262, 3.0), (262, 2, 1.0)]
    pairs = core + chains + stars
    ids = sorted({n for e in pairs for n in e[:2]})
    lap = np.zeros((len(ids), len(ids)))
    for u, v, w in pairs:
        i, j = ids.index(u), ids.index(v)
        lap[[i, j, i, j], [i, j, j, i]] += [w, w, -w, -w]
    edges = spark.createDataFrame([(min(u, v), max(u, v), w) for u, v, w in pairs], "src long, dst long, w double")
    b = rng.normal(size=len(ids))
    right = spark.createDataFrame([(int(k), 0, float(x)) for k, x in zip(ids, b, strict=True)], "node long, block int, b0 double")
    for ground in ((), (40, 205)):
        keep = [k for k, i in enumerate(ids) if i not in ground]
        want = np.linalg.solve(lap[np.ix_(keep, keep)], b[keep]) if ground else np.linalg.pinv(lap) @ b
        system = V.System(edges, scratch, ground, "tables")
        assert system.core.left <= 12 and len(system.core.rounds) <= 20
        found = {r["node"]: r["x0"] for r in system.solve(right.filter(~F.col("node").isin(list(ground))), 1e-12)[0].collect()}
        assert [found[ids[k]] for k in keep] == pytest.approx(want.tolist(), abs=1e-9)
    tree = V.System(edge_table(spark, [(i, i // 3) for i in range(1, 60)]), scratch, plan="tables")
    assert tree.core.left == 1
    x = {r["node"]: r["x0"] for r in tree.solve(right.filter("node = 8"))[0].collect()}
    ids, lap = dense([(i, i // 3) for i in range(1, 60)])
    assert [x[i] for i in ids] == pytest.approx((np.linalg.pinv(lap)[:, ids.index(8)] * b[8]).tolist(), abs=1e-9)
    with pytest.raises(ValueError):
        V.System(edges, scratch, plan="rows")


def test_a_loop_keeps_one_state(spark, scratch):
    import pathlib

    right = spark.createDataFrame([(1, 0, 1.0), (18, 0, -1.0)], "node long, block int, b0 double")
    V.System(edge_table(spark, TEST18), scratch, plan="tables", reduce=False).solve(right, 1e-10)
    names = [p.name.split("-")[0] for p in pathlib.Path(scratch.top.removeprefix("file:")).iterdir()]
    assert names.count("cg") == 1 and names.count("steps") == 1


def test_large_graphs_are_solved_in_pieces(spark, scratch, monkeypatch):
    """A graph that mixes fast needs no elimination by tables; isolated pairs and a weighted graph among them come out right."""
    rng = np.random.default_rng(7)
    sides = {(int(u), 1000 + int(v)) for u, v in zip(rng.integers(0, 120, 500), rng.integers(0, 40, 500), strict=True)}
    mixed = {(min(u, v), max(u, v)) for u, v in rng.integers(0, 60, (300, 2)).tolist() if u != v}
    monkeypatch.setattr(V, "LARGE", 0)
    monkeypatch.setattr(V, "System", None)
    for pairs, weigh in ((sides | {(2000, 2001)}, False), (mixed, True)):
        pairs = [(u, v, float(rng.uniform(0.5, 2)) if weigh else 1.0) for u, v in sorted(pairs)]
        ids = sorted({n for e in pairs for n in e[:2]})
        lap, b = np.zeros((len(ids), len(ids))), np.zeros((len(ids), 2))
        for u, v, w in pairs:
            i, j, c = ids.index(u), ids.index(v), rng.normal(size=2)
            lap[[i, j, i, j], [i, j, j, i]] += [w, w, -w, -w]
            b[i], b[j] = b[i] + c, b[j] - c
        edges = spark.createDataFrame(pairs, "src long, dst long, w double")
        right = spark.createDataFrame([(i, *map(float, row)) for i, row in zip(ids, b, strict=True)], "node long, p double, q double")
        x, residual = V.solve_by_shuffle(edges if weigh else edges.drop("w"), right, ["p", "q"], scratch, 1e-10)
        found = {r["node"]: (r["p"], r["q"]) for r in x.collect()}
        assert residual <= 1e-10 and sorted(found) == ids
        solution = np.array([found[i] for i in ids])
        assert lap @ solution == pytest.approx(b, abs=1e-7) and solution.sum(0) == pytest.approx(0, abs=1e-8)


def test_what_pieces_do_not_solve_goes_by_tables(spark, scratch, monkeypatch):
    """A long path takes too many rounds, a hub too many rows of one piece."""
    from galvani.operators import pieces

    monkeypatch.setattr(V, "LARGE", 0)
    monkeypatch.setattr(V, "TRIAL", 3)
    path = edge_table(spark, [(i, i + 1) for i in range(80)])
    right = spark.createDataFrame([(0, 1.0), (80, -1.0)], "node long, b double")
    assert pieces.solve(path, right, ["b"], scratch, 1e-10, 3) is None
    found = {r["node"]: r["b"] for r in V.solve_by_shuffle(path, right, ["b"], scratch, 1e-10)[0].collect()}
    assert [found[i] for i in range(81)] == pytest.approx([40.0 - i for i in range(81)], abs=1e-6)
    monkeypatch.setattr(pieces, "MOST", 20)
    assert pieces.solve(edge_table(spark, [(0, i) for i in range(1, 40)]), right, ["b"], scratch, 1e-10, 50) is None


#: A triangle with a leaf and, over a bridge, a cycle.
PAW_AND_TAIL = [(1, 2), (2, 3), (1, 3), (3, 4), (2, 5), (5, 6), (6, 7), (5, 7)]


@pytest.mark.parametrize("plan", ["columns", "tables"])
def test_large_graphs_and_blocks_are_solved_for(spark, scratch, plan):
    ids, lap = dense(PAW_AND_TAIL)
    edges = scratch.table(edge_table(spark, PAW_AND_TAIL))
    inverse = {(r["i"], r["j"]): r["val"] for r in R.pseudo_inverse(edges, scratch, plan).collect()}
    want = np.linalg.pinv(lap)
    assert inverse == pytest.approx({(u, v): want[i, j] for i, u in enumerate(ids) for j, v in enumerate(ids)}, abs=1e-8)
    bridges = scratch.table(B.find_bridges(edges, scratch))
    far = dict(rows(D.decomposed_farness(edges, bridges, scratch, most=2)))
    assert far == pytest.approx({u: len(ids) * want[i, i] + np.trace(want) for i, u in enumerate(ids)}, abs=1e-6)


def _bridges_by_search(pairs):
    """Bridges by removing each edge in turn."""
    found = set()
    for gone in set(pairs):
        near = {}
        for u, v in pairs:
            if (u, v) != gone:
                near.setdefault(u, []).append(v)
                near.setdefault(v, []).append(u)
        seen, todo = {gone[0]}, [gone[0]]
        while todo:
            for v in near.get(todo.pop(), []):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        if gone[1] not in seen:
            found.add(gone)
    return sorted(found)


def test_bridges_of_random_graphs(spark, scratch):
    """Sparse parts, trees, stars, rings, and edges alone, in one graph of many components."""
    rng = random.Random(8)
    pairs = set()
    for part in range(12):
        n = rng.choice([2, 3, 10, 25])
        ids = rng.sample(range(part * 100, part * 100 + 100), n)
        pairs |= {tuple(sorted((ids[k], ids[rng.randrange(k)]))) for k in range(1, n)}
        pairs |= {tuple(sorted(rng.sample(ids, 2))) for _ in range(rng.choice([0, 1, n // 4]))}
    pairs |= {(5000, 5001 + k) for k in range(60)} | {(6000 + k, 6001 + k) for k in range(30)} | {(6000, 6030)}
    pairs = sorted(pairs)
    assert rows(B.find_bridges(edge_table(spark, pairs), scratch)) == _bridges_by_search(pairs)
    assert rows(B.find_bridges(edge_table(spark, pairs[:1]).limit(0), scratch)) == []


def test_bridges_of_deep_graphs_take_few_rounds(spark, scratch, monkeypatch):
    """A path of 3000 nodes with a ring at its end: tables grow in number with the logarithm of its length."""
    made = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, *a, **k: made.append(1) or table(self, df, *a, **k))
    path = [(k, k + 1) for k in range(3000)] + [(2990, 3000)]
    found = rows(B.find_bridges(edge_table(spark, path), scratch))
    assert found == [(k, k + 1) for k in range(2990)] and len(made) < 60


def test_sums_over_rooted_forests(spark, scratch):
    """A deep tree, a star, a path, two nodes and a root alone; sums against those over each node's own ancestors."""
    rng = random.Random(2)
    parent = {k: max(0, k - rng.choice([1, 1, 1, 2, 9])) for k in range(1, 120)} | {300 + k: 300 for k in range(1, 20)} | {401: 400}
    edges = edge_table(spark, list(parent.items()))
    roots = spark.createDataFrame([(0,), (300,), (400,), (500,)], "node long")
    forest = T.RootedForest(edges, roots, scratch)
    assert dict(rows(forest.parents)) == parent
    value = {k: float(rng.randrange(100)) for k in [*parent, 0, 300, 400, 500]}
    table = spark.createDataFrame(list(value.items()), "node long, value double")
    below, above = dict.fromkeys(value, 0.0), dict.fromkeys(value, 0.0)
    for k, v in value.items():
        at = k
        while True:
            below[at] += v
            if at not in parent:
                break
            above[k] += value[at]
            at = parent[at]
    assert dict(rows(forest.below(table))) == pytest.approx(below)
    assert dict(rows(forest.above(table))) == pytest.approx(above)


def test_farness_of_a_deep_graph_takes_few_rounds(spark, scratch, monkeypatch):
    """Rings on a long chain of bridges: tables grow in number with the logarithm of its length."""
    pairs = []
    for k in range(60):
        a = 10 * k
        pairs += [(a, a + 1), (a + 1, a + 2), (a, a + 2), (a + 2, a + 5), (a + 5, a + 10)]
    pairs += [(600, 601), (601, 602)]
    edges = scratch.table(edge_table(spark, pairs))
    bridges = scratch.table(B.find_bridges(edges, scratch))
    made = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, *a, **k: made.append(1) or table(self, df, *a, **k))
    found = dict(rows(D.decomposed_farness(edges, bridges, scratch)))
    ids, lap = dense(pairs)
    want = np.linalg.pinv(lap)
    assert found == pytest.approx({u: len(ids) * want[i, i] + np.trace(want) for i, u in enumerate(ids)}, rel=1e-8)
    assert len(made) < 90


def shortest(triples, starts):
    far = {}
    for a, b, w in triples:
        if a != b:
            far.setdefault(a, []).append((b, w))
            far.setdefault(b, []).append((a, w))
    out = {}
    for source in {s for s, _ in starts}:
        heap, best = [(0.0, u) for s, u in starts if s == source], {}
        while heap:
            d, u = heapq.heappop(heap)
            if u not in best:
                best[u] = d
                for v, w in far.get(u, []):
                    heapq.heappush(heap, (d + w, v))
        out.update({(source, u): d for u, d in best.items()})
    return out


def found_paths(spark, scratch, triples, starts):
    graph = spark.createDataFrame(triples, "a long, b long, w double")
    found = rows(P.shortest_paths(graph, spark.createDataFrame(starts, "source long, node long"), scratch))
    out = {(s, u): d for s, u, d in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shortest_paths_of_random_graphs(spark, scratch, seed):
    """Trees, chains, rings, dense parts, several components, edges that repeat, loops, starts inside and outside."""
    rng = random.Random(seed)
    n = 40
    triples = [(u, rng.randrange(max(0, u - 3), u), rng.choice([0.5, 1.0, 2.25])) for u in range(1, n) if rng.random() < 0.9]
    triples += [(rng.randrange(n), rng.randrange(n), rng.random() + 0.01) for _ in range((0, 5, 25, 90)[seed])]
    triples += [(u, v, w + 1) for u, v, w in triples[:3]] + [(7, 7, 1.0)]
    starts = [(s, rng.randrange(n)) for s in range(4) for _ in range(1 + s % 2)] + [(9, 1000)]
    assert found_paths(spark, scratch, triples, starts) == pytest.approx(shortest(triples, starts))


def test_shortest_paths_of_nothing(spark, scratch):
    assert found_paths(spark, scratch, [], [(1, 2)]) == {(1, 2): 0.0}
    assert found_paths(spark, scratch, [(1, 2, 1.0)], []) == {}
    assert found_paths(spark, scratch, [(1, 2, 1.0), (None, 2, 1.0), (2, 3, None)], [(0, 2), (0, None)]) == {(0, 1): 1.0, (0, 2): 0.0}


def test_shortest_paths_along_a_chain_take_few_rounds(spark, scratch, monkeypatch):
    """5,000 bridges in a row between two squares."""
    triples = [(u, u + 1, 1.0) for u in range(5000)] + [(-1, 0, 0.75), (-2, 0, 0.75), (-1, -3, 0.75), (-2, -3, 0.75), (5000, 6000, 0.5)]
    made = []
    table = Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, *a, **k: made.append(1) or table(self, df, *a, **k))
    starts = [(0, -3), (1, 2500)]
    assert found_paths(spark, scratch, triples, starts) == pytest.approx(shortest(triples, starts))
    assert len(made) < 150


def test_a_forest_spans(spark, scratch):
    pairs = [(u, v) for u, v in TEST18] + [(100, 101), (101, 102), (100, 102)]
    forest, roots = B.spanning_forest(edge_table(spark, pairs), scratch)
    kept = rows(forest)
    assert set(kept) <= {tuple(sorted(p)) for p in pairs} and len(kept) == 17 + 2 and roots.count() == 2
    assert K.connected_components(forest, scratch.table).select("component").distinct().count() == 2


def test_a_value_is_stretched(spark, scratch):
    one, two = (C.exact_greedy(edge_table(spark, TRIANGLE), 1, scratch, stretch=s)[1].first()["centrality"] for s in (0.0, 2.5))
    assert two == pytest.approx(2.5 * one)


def test_estimates_do_not_depend_on_partitions(spark):
    edges = edge_table(spark, TEST18)
    a, b = (dict(rows(R.Estimates(e, 3).diagonal())) for e in (edges, edges.repartition(3)))
    assert a == pytest.approx(b)
    assert projections(20, 1) == 1 and projections(20, 18) == 58


def _random_graph(rng, n, more):
    tree = {tuple(sorted((k, rng.randrange(max(0, k - 4), k)))) for k in range(1, n)}
    return sorted(tree | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(more)})


#: A path that elimination takes whole, a star, two nodes, a sparse graph, and one without leaves or chains.
SHAPES = {
    "path": [(k, k + 1) for k in range(70)],
    "star": [(0, k) for k in range(1, 40)],
    "two": [(4, 9)],
    "sparse": _random_graph(random.Random(5), 90, 25),
    "complete": [(a, b) for a in range(9) for b in range(a + 1, 9)],
}


@pytest.mark.parametrize("shape,plan,reduce", [("path", "auto", True), ("star", "auto", True), ("two", "auto", None), ("sparse", "auto", None), ("sparse", "auto", True), ("complete", "tables", True)])
def test_selected_entries_are_those_of_the_inverse(spark, scratch, monkeypatch, shape, plan, reduce):
    monkeypatch.setattr(Z, "AT_ONCE", 4)
    ids, lap = dense(SHAPES[shape])
    at, want = {u: i for i, u in enumerate(ids)}, np.linalg.pinv(lap)
    parts = Q.Parts(scratch.table(edge_table(spark, SHAPES[shape])), scratch, plan=plan, reduce=reduce)
    assert {r["node"]: r["value"] for r in parts.diagonal().collect()} == pytest.approx({u: want[i, i] for u, i in at.items()}, abs=1e-9)
    far = lambda u, v: want[at[u], at[u]] + want[at[v], at[v]] - 2 * want[at[u], at[v]]
    assert {(r["src"], r["dst"]): r["r"] for r in parts.resistances().collect()} == pytest.approx({e: far(*e) for e in SHAPES[shape]}, abs=1e-9)
    if shape == "path":
        assert parts.system.core.left < 10
    if shape == "two":
        with pytest.raises(ValueError):
            Z.selected_inverse(V.System(edge_table(spark, SHAPES[shape]), scratch))


def test_columns_in_batches_leave_one_batch_on_disk(spark, scratch, monkeypatch):
    import pathlib

    monkeypatch.setattr(Z, "AT_ONCE", 4)
    Z.selected_inverse(Q.Parts(scratch.table(edge_table(spark, SHAPES["complete"])), scratch, plan="tables").system)
    names = [p.name.split("-")[0] for p in pathlib.Path(scratch.top.removeprefix("file:")).iterdir()]
    assert names.count("selected") == 2 and names.count("cg") == 0 and names.count("own") == 1


def test_graphs_that_share_names_are_solved_for_at_once(spark, scratch):
    """Three graphs, one with a node seen in a loop alone, repeated and reversed edges, and rows with nulls."""
    graphs = {"a": TRIANGLE, "b": PATH7, "c": TEST18}
    given = [(g, *e) for g, edges in graphs.items() for e in edges] + [("b", 2, 1), ("c", 14, 1), ("d", 3, 3), (None, 1, 2), ("a", None, 2)]
    edges = spark.createDataFrame(given, "graph_id string, src long, dst long")
    many = Q.ManyGraphs(edges, scratch)
    parts = Q.Parts(many.edges, scratch, many.names.select("node", F.col("graph_id").alias("part")))
    found = {(r["graph_id"], r["node"]): (r["farness"], r["centrality"]) for r in many.named(parts.centralities().drop("part")).collect()}
    want = {("d", 3): (0.0, None)}
    for g, pairs in graphs.items():
        ids, lap = dense(pairs)
        m = np.linalg.pinv(lap)
        want |= {(g, u): (len(ids) * m[i, i] + np.trace(m), len(ids) / (len(ids) * m[i, i] + np.trace(m))) for i, u in enumerate(ids)}
    assert found.keys() == want.keys()
    assert all(a == pytest.approx(want[k][0], abs=1e-8) and (b == want[k][1] or b == pytest.approx(want[k][1], abs=1e-8)) for k, (a, b) in found.items())
    bridges = rows(many.named(B.find_bridges(many.edges, scratch).select("src", "dst"), "src", "dst"))
    assert bridges == sorted((g, *e) for g, pairs in graphs.items() for e in _bridges_by_search(sorted({tuple(sorted(x)) for x in pairs})))
    empty = Q.ManyGraphs(edges.limit(0), scratch)
    assert rows(Q.Parts(empty.edges, scratch).centralities()) == []


def test_parts_are_solved_and_estimated_apart(spark, scratch):
    """L+ b in each part, b not of mean zero; estimates within their error."""
    rng = random.Random(1)
    one, two = _random_graph(rng, 30, 30), [(u + 100, v + 100) for u, v in _random_graph(rng, 50, 60)]
    edges = scratch.table(edge_table(spark, one + two))
    named = E.nodes(edges).withColumn("part", (F.col("node") >= 100).cast("int"))
    parts = Q.Parts(edges, scratch, named)
    right = named.select(F.lit(0).alias("block"), "node", (F.col("node") % 7).cast("double").alias("b0"))
    x = {r["node"]: r["x0"] for r in parts.solve(right).collect()}
    d = {r["node"]: r["value"] for r in parts.diagonal().collect()}
    guess = {r["node"]: r["value"] for r in parts.estimated_diagonal(200).collect()}
    for pairs in (one, two):
        ids, lap = dense(pairs)
        m = np.linalg.pinv(lap)
        assert [x[u] for u in ids] == pytest.approx(list(m @ np.array([u % 7 for u in ids], float)), abs=1e-8)
        assert [d[u] for u in ids] == pytest.approx(list(np.diag(m)), abs=1e-9)
        assert [guess[u] for u in ids] == pytest.approx(list(np.diag(m)), rel=0.3)


def test_all_giant_blocks_are_one_system(spark, scratch, monkeypatch):
    """Three rings with chords on a line of bridges, a leaf on each: as many systems for three giants as for one."""
    made = []
    system = V.System.__init__
    monkeypatch.setattr(V.System, "__init__", lambda self, *a, **k: made.append(1) or system(self, *a, **k))
    pairs = []
    for k in range(3):
        ring = [100 * k + i for i in range(8)]
        pairs += [(ring[i], ring[(i + 1) % 8]) for i in range(8)] + [(ring[0], ring[4]), (ring[7], 100 * k + 50)]
        pairs += [(100 * k - 95, ring[1])] if k else []
    pairs = sorted(tuple(sorted(e)) for e in pairs)
    ids, lap = dense(pairs)
    m = np.linalg.pinv(lap)
    edges = scratch.table(edge_table(spark, pairs))
    bridges = scratch.table(B.find_bridges(edges, scratch))
    far = dict(rows(D.decomposed_farness(edges, bridges, scratch, most=5)))
    assert far == pytest.approx({u: len(ids) * m[i, i] + np.trace(m) for i, u in enumerate(ids)}, abs=1e-6)
    assert len(made) == 1
    rough = dict(rows(D.decomposed_farness(edges, bridges, scratch, most=5, factor=300)))
    assert [rough[u] for u in ids] == pytest.approx([far[u] for u in ids], rel=0.2)


HAIRY = [(1, 2), (2, 3), (3, 4), (1, 4), (1, 3), (4, 5)] + [(1, 10 + i) for i in range(4)] + [(3, 20 + i) for i in range(2)] + [(5, 30), (2, 40)]


@pytest.mark.parametrize("edges", [HAIRY, PATH7, TRIANGLE, [(1, 2)], [(1, i) for i in range(2, 7)]])
def test_classes_hold_the_inverse(spark, scratch, monkeypatch, edges):
    monkeypatch.setattr(L, "GROUP", 3)
    found = L.Classes(scratch.table(edge_table(spark, edges)), scratch)
    ids, lap = dense(edges)
    n, m = len(ids), np.linalg.pinv(lap)
    d = np.diag(m)
    r = d[:, None] + d[None, :] - 2 * m
    near = lambda x: pytest.approx(x, abs=1e-8)
    assert {(x["i"], x["j"]): x["val"] for x in found.entries().collect()} == near({(ids[i], ids[j]): m[i, j] for i in range(n) for j in range(n)})
    pairs = found.all_pairs_resistance().collect()
    assert len(pairs) == n * (n - 1) // 2
    assert {(x["u"], x["v"]): x["r"] for x in pairs} == near({(ids[i], ids[j]): r[i, j] for i in range(n) for j in range(i + 1, n)})
    assert dict(rows(found.farness_of_pairs())) == near(dict(zip(ids, r.sum(1), strict=True)))
    assert dict(rows(found.grounded_traces())) == near(dict(zip(ids, r.sum(1), strict=True)))
    assert dict(rows(found.column_squares())) == near(dict(zip(ids, (m * m).sum(0), strict=True)))
    assert found.trace().first()[0] == near(np.trace(m))
    on_edges = found.pair_resistance(edge_table(spark, edges))
    assert sum(x["r"] for x in on_edges.collect()) == near(n - 1) and on_edges.count() == len(edges)


def test_all_pairs_are_dealt_by_pieces_of_classes(spark, scratch, monkeypatch):
    """A class of 300 leaves is no key of its own, and what is rounded is a class's value, not that of each pair."""
    monkeypatch.setattr(L, "GROUP", 10)
    monkeypatch.setattr(L, "PAIRS", 2000)
    found = L.Classes(scratch.table(edge_table(spark, [(1, i) for i in range(2, 302)])), scratch)
    ids, lap = dense([(1, i) for i in range(2, 302)])
    m = np.linalg.pinv(lap)
    r = np.diag(m)[:, None] + np.diag(m)[None, :] - 2 * m
    for wide, names, exact in ((found.entries(digits=3), ("i", "j", "val"), m), (found.all_pairs_resistance(digits=3), ("u", "v", "r"), r)):
        tasks = wide.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
        assert tasks[0] < 2 * L.PAIRS and tasks[1] == (301**2 if names[2] == "val" else 301 * 150)
        off = [abs(x[names[2]] - exact[x[names[0]] - 1, x[names[1]] - 1]) for x in wide.collect()]
        assert max(off) < 0.00051 and wide.select(names[2]).distinct().count() < 5
        steps = wide._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert max(k for k, x in enumerate(steps) if "Generate explode" in x) < min(k for k, x in enumerate(steps) if "round(" in x and "Union" not in x)


def test_only_the_graph_without_leaves_is_solved_for(spark, scratch, monkeypatch):
    """60 leaves on a triangle: three nodes are solved for, and all entries are exact."""
    asked, solved = [], L.solved_columns

    def watched(edges, wanted, *args, **named):
        asked.append((edges.count(), wanted.count()))
        return solved(edges, wanted, *args, **named)

    monkeypatch.setattr(L, "solved_columns", watched)
    pairs = TRIANGLE + [(1 + i % 2, 10 + i) for i in range(60)]
    found, (ids, lap) = L.Classes(scratch.table(edge_table(spark, pairs)), scratch), dense(pairs)
    m = np.linalg.pinv(lap)
    assert {(x["i"], x["j"]): x["val"] for x in found.entries().collect()} == pytest.approx({(ids[i], ids[j]): m[i, j] for i in range(len(ids)) for j in range(len(ids))}, abs=1e-10)
    assert asked == [(3, 3)]


def test_classes_are_grounded(spark, scratch):
    found, (ids, lap) = L.Classes(scratch.table(edge_table(spark, HAIRY)), scratch), dense(HAIRY)
    gone = []
    for node in (20, 21, 11, 4, 10):  # a class of two goes, one of four loses two
        found = found.ground(node)
        gone.append(node)
        keep = [k for k, x in enumerate(ids) if x not in gone]
        m = np.linalg.inv(lap[np.ix_(keep, keep)])
        assert dict(rows(found.diagonal())) == pytest.approx({ids[k]: m[i, i] for i, k in enumerate(keep)}, abs=1e-8)
        assert dict(rows(found.column_squares())) == pytest.approx({ids[k]: (m * m).sum(0)[i] for i, k in enumerate(keep)}, abs=1e-8)


def test_leaves_of_a_hub_need_one_column(spark, scratch, monkeypatch):
    """300 leaves are two classes; greedy groups take the classes, not a solve a node."""
    edges = scratch.table(edge_table(spark, [(1, 2)] + [(1 + i % 2, 10 + i) for i in range(300)]))
    found = L.Classes(edges, scratch)
    assert found.count() == 4 and found.cells.count() == 4 * 3 + 2
    monkeypatch.setattr(V.System, "profile", None)
    best = C.exact_greedy(edges, 2, scratch, most=10)[0].filter("rank = 1").orderBy("step")
    assert [r["node"] for r in best.collect()] == [1, 2]


def test_graphs_by_columns_lose_their_leaves_first(spark, scratch, monkeypatch):
    edges = scratch.table(edge_table(spark, TRIANGLE + [(1 + i % 3, 10 + i) for i in range(60)]))
    assert not V.System(edges, scratch, (1,)).core.rounds
    monkeypatch.setattr(V, "SMALL", 32)
    system = V.System(edges, scratch, (1,))
    assert system.whole and system.by_columns and system.core.left < 8


def test_blocks_without_edges_need_no_task(spark):
    blocks = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (5, 5)], "block long, node long")
    alone, linked = D._by_edges(blocks, spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 1, 3)], "block long, src long, dst long"))
    assert rows(alone) == [(4, 4), (5, 5)] and rows(linked) == [(1, 1), (1, 2), (1, 3)]


def test_a_hub_is_not_gathered_in_one_task(spark, scratch, monkeypatch):
    monkeypatch.setattr(K, "HUB", 300)
    star = spark.range(1, 4001).repartition(4).selectExpr("id AS u", "0L AS v").union(spark.range(1, 4001).selectExpr("0L", "id"))
    kept = scratch.table(star)
    least, joined = K._least(kept, kept.filter("v > u"), scratch.table)
    assert joined.count() == 4000 and least.filter("u = 0").first()["m"] == 1
    assert joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4000


def test_rounds_of_components_have_tasks_for_their_edges(spark, scratch, monkeypatch):
    monkeypatch.setattr(K, "HUB", 30)
    monkeypatch.setattr(scratch_module, "TASK_ROWS", 100)
    rng, tasks = random.Random(5), []
    pairs = [(rng.randrange(900), rng.randrange(900)) for _ in range(500)] + [(5000, i) for i in range(200)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7), (8000, 8000)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")}

    def kept(df):
        tasks.append(int(spark.conf.get("spark.sql.shuffle.partitions")))
        return scratch.table(df)

    found = dict(rows(K.connected_components(spark.createDataFrame(pairs, "a long, b long"), kept)))
    label = {x: x for p in pairs for x in p}
    while any(label[a] != label[b] for a, b in pairs):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert found == label
    assert max(tasks) >= 2 * 999 // 100 and {k: spark.conf.get(k) for k in before} == before
