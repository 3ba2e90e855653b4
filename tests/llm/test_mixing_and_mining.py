"""Operators 11 to 13 against plain Python: targets and permutations, exact negatives, exact phrase counts."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from galvani.llm.collocations import mine_phrases
from galvani.llm.mixing import Draws, Mix, mix_digest, targets
from galvani.llm.negatives import Search, intervals, known_vectors, mine_negatives, scores

DOCS = "doc_id long, text string, source string, lang string"


# --- 11 -----------------------------------------------------------------------------------------------------------------


def test_targets_stop_at_three_times_and_share_the_rest():
    assert targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert targets([1, 1, 98], [1, 2, 3]) == [3.0, 3.0, 94.0]
    assert targets([0, 0], [1, 2]) == [0.0, 0.0] and targets([], []) == []
    rng = random.Random(1)
    for _ in range(200):
        z = [rng.choice([0, 1, 5, rng.randrange(1000)]) for _ in range(rng.randrange(1, 12))]
        w = [1 + k % 3 for k in range(len(z))]
        got = targets(z, w)
        assert abs(sum(got) - sum(z)) < 1e-6 * max(1, sum(z)) and all(t <= 3 * x for t, x in zip(got, z, strict=True))
        rates = {Fraction(t).limit_denominator(10**9) / k for t, x, k in zip(got, z, w, strict=True) if t < 3 * x}
        assert max(rates, default=0) - min(rates, default=0) < 1e-6  # those that aren't held have one rate, the largest
        assert all(3 * x <= max(rates) * k + Fraction(1, 10**6) for t, x, k in zip(got, z, w, strict=True) if t == 3 * x and rates)


def test_draws_keep_quotas_and_permute():
    draws = Draws([7, 1, 100, 0, 33], [21, 2, 150, 0, 10], seed=3, shard=16)
    taken, seen = Counter(), []
    for shard in range(draws.shards):
        source, block = draws.slots(shard)
        assert len(source) == (16 if shard + 1 < draws.shards else 183 - 16 * (draws.shards - 1))
        seen.append(np.bincount(source, minlength=5))
        taken.update(zip(source.tolist(), block.tolist(), strict=True))
    assert np.array(seen).sum(0).tolist() == [21, 2, 150, 0, 10]
    assert all(taken[0, b] == 3 for b in range(7)) and taken[1, 0] == 2 and {taken[2, b] for b in range(100)} == {1, 2}
    assert sorted(taken[4, b] for b in range(33)) == [0] * 23 + [1] * 10
    assert len({tuple(x) for x in seen}) > 3  # counts differ from shard to shard
    n = np.arange(1000)
    big = Draws([1000], [1000])
    assert sorted(big.permuted(n * 0, n * 0, n)) == n.tolist() and (big.permuted(n * 0, n * 0, n) != big.permuted(n * 0, n * 0 + 1, n)).any()


def _mixed(spark, rows, **kw):
    return Mix(spark.createDataFrame(rows, DOCS), **kw)


def test_mix_is_whole_and_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["a", "b", "ß", None]), "en") for k in range(300)]
    rows += [(1000, " ".join("x" * 3000), "a", None), (1001, None, "zero", None), (1001, None, "zero", None), (7, "one two", "a", "en"), (7, "one two", "a", "en"), (None, "three \t\x0b four\n", None, "en")]
    mix = _mixed(spark, rows, block=16, shard=64)
    docs = {}
    for r in mix.rows.collect():
        docs[r["rank"], r["first"], r["size"]] = r
    assert len(docs) == len({(k[0], k[1]) for k in docs if k[2]}) + sum(1 for k in docs if not k[2]) and mix.rows.count() == len(rows)
    assert [r["source"] for r in sorted({(r["rank"], r["source"]): r for r in mix.rows.collect()}.values(), key=lambda r: r["rank"])] == ["a", "b", "zero", "ß", None]
    size = defaultdict(int)
    for _, text, source, _ in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert all(r["source_size"] == size[r["source"]] for r in docs.values())
    mixed, slots = mix.mixed().collect(), mix.slots().collect()
    length = Counter()
    for m in mixed:
        length[m["shard"], m["position"]] += m["length"]
    assert set(length) == {(s["shard"], s["position"]) for s in slots} and max(length.values()) == 16
    taken, want = Counter(), {r["rank"]: r["target"] for r in docs.values()}
    for m in mixed:
        taken[m["rank"]] += m["length"]
    assert all(abs(taken[k] - t) <= 16 for k, t in want.items())
    texts = {(t["shard"], t["position"]): t for t in mix.texts().collect()}
    assert set(texts) == set(length) and all(len(t["text"].split()) == t["words"] == length[k] for k, t in texts.items())
    first = next(m for m in mixed if m["doc_id"] == 1000 and m["start"] > 100 and m["length"] == 16)
    assert texts[first["shard"], first["position"]]["text"] == " ".join("x" * 16)


def test_mix_digest_reruns_alike_whatever_the_partitions(spark):
    rows = [(k, "word " * (k % 50), f"s{k % 4}", "en") for k in range(400)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS rank", "3 AS taken", "'x' AS part")
    a = sorted(map(tuple, mix_digest(frame).collect()))
    b = sorted(map(tuple, mix_digest(frame.repartition(7)).collect()))
    assert a == b and len(a) == 400 and all(0 <= r[4] <= 3 * r[1] for r in a)
    assert mix_digest(spark.createDataFrame([], DOCS)).count() == 0
    nothing = mix_digest(spark.createDataFrame([(1, None, None, None), (2, " ", "a", None)], DOCS)).collect()
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in nothing) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


# --- 12 -----------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def _brute(rows, anchors=50, positives=5, negatives=3):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in v)
        kept[i] = min(kept.get(i, ((label + 1) % 10 if i % 7 == 0 else label, q)), ((label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for a in (i for i in kept if i % anchors == 0):
        by = sorted(((max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(kept[a][1], q, strict=False)))), -i, label) for i, (label, q) in kept.items() if i != a), reverse=True)
        for score, p, _ in [b for b in by if b[2] == kept[a][0]][:positives]:
            hard = [b for b in by if b[2] != kept[a][0] and 50 * score <= 100 * b[0] <= 95 * score][:negatives]
            out += [(a, -p, k, -n, score, s) for k, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


def _clustered(rng, n, wide=8):
    centers = rng.normal(size=(6, wide)) * 3
    return [(i, (centers[i % 6] * (1 + 0.4 * (i % 3)) + rng.normal(size=wide) * 0.3).astype(np.float32).tolist(), int(i // 6 % 3 + i % 2)) for i in range(n)]


def test_negatives_equal_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = _clustered(rng, 1500)
    rows += [(1500 + k, rows[0][1], k % 4) for k in range(200)]  # a hot vector, ties by id
    rows += [(2000, None, 1), (2050, [1.0, None] + [0.0] * 6, 1), (2100, [float("nan")] * 8, 1), (2150, [float("inf")] * 8, 2), (2200, [0.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [rows[3], rows[0], (6, [0.5] * 8, 0), (2251, [], 1), (2250, [0.0] * 8, 1), (2300, [1.0, 2.0], 2), (2350, [3.0] * 12, 2)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS score", "2 AS node", "'x' AS a", "3 AS x").repartition(5)
    got = mine_negatives(frame, block=64, anchor_block=8, leaf=16, anchor_leaf=4)
    want = _brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert sorted(map(tuple, mine_negatives(frame).collect())) == want  # one block
    assert mine_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert mine_negatives(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).count() == 0


def test_whole_groups_of_anchors_are_given_up(spark):
    from galvani.llm.common import Scratch
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centers[i % 40] + rng.normal(size=16) * 0.05).astype(np.float32).tolist(), 1) for i in range(8000)]
    frame = known_vectors(spark.createDataFrame(rows, VECTORS))
    scratch = Scratch(spark)
    search = Search(frame.filter("vec_id % 10 = 0"), scratch.table(frame), scratch, block=64, anchor_block=16, leaf=16, anchor_leaf=8)
    blocks = search.left.levels[0].select(F.col("node").alias("a"), "center")
    near = blocks.select("a", (F.aggregate("center", F.lit(0.0), lambda s, x: s + x * x) * 0.98).alias("lo"), F.lit(1e30).alias("hi"))
    pairs, every = search.pairs(near, True).count(), search.left.sizes[0] * search.right.sizes[0]
    assert len(search.right.levels) >= 3 and pairs < every / 4


def test_scores_and_intervals():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**40), 2**40, (3, 5)).astype(float), rng.integers(-(2**40), 2**40, (4, 7)).astype(float)
    exact = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(u, v, strict=False)))) for v in b] for u in a]
    assert scores(a, b).tolist() == exact
    assert scores(np.zeros((2, 0)), np.ones((1, 3))).tolist() == [[0], [0]]
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(60, 6)) + 1
    ra, rb = np.sqrt(((x - x.mean(0)) ** 2).sum(1)).max(), np.sqrt(((y - y.mean(0)) ** 2).sum(1)).max()
    lo, hi = intervals(x.mean(0)[None], np.array([ra]), y.mean(0)[None], np.array([rb]))
    assert lo[0, 0] <= (x @ y.T).min() and (x @ y.T).max() <= hi[0, 0]


# --- 13 -----------------------------------------------------------------------------------------------------------------


def _phrases(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, _, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = defaultdict(int)
        for p, a in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        kept = []
        for p, a in often.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["New", "york", "City", "of", "the", "é", "Éa", "a,b", "x.", "!", "z\tq"]
    rows = [(k, " ".join(rng.choices(vocabulary, weights=range(11, 0, -1), k=rng.choice([0, 1, 3, 60, 200]))), None, rng.choice(["en", "en", "de", None, "und"])) for k in range(300)]
    rows += [(None, "hot phrase here\n" * 2000, None, "en"), (7, None, None, "en"), (7, "Hot phrase here", None, "en"), (7, "Hot phrase here", None, "en"), (8, "a a a a a a " * 50, None, "fr"), (9, "w" * 100_000 + " " + "w" * 100_000, None, "fr"), (10, "", None, None)]
    frame = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS block", "2 AS word", "'x' AS phrase", "3 AS rank", "4 AS n").repartition(5)
    for least, top, block in ((30, 2000, 8_000_000), (3, 20, 2000)):
        got = sorted(map(tuple, mine_phrases(frame, least, top, block_bytes=block).collect()))
        assert got == _phrases(rows, least, top)
    assert {r[0] for r in got} == {"en", "de", "fr", "und"}
    assert mine_phrases(spark.createDataFrame([], DOCS)).count() == 0 and mine_phrases(spark.createDataFrame([(1, None, None, None)], DOCS)).count() == 0
