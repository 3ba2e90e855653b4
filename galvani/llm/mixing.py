"""Mixing sources to target weights: fixed-length blocks, multinomial counts for each output shard, and blocks by index."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, placed
from .hashing import mix

#: Words of a block, blocks of a shard, and how many times a source may be taken at most.
BLOCK, SHARD, MOST = 64, 4096, 3
WEIGHTS = (1, 2, 3)
SEED = 11

_WORD, _BLANKS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Words that each source shall give: the sum of all sizes shared out by weight. Who would give over `most` times
    its size gives that, and the others share the excess by weight, until none is above. In whole numbers throughout."""
    left, held = sum(sizes), [False] * len(sizes)
    while True:
        weight = sum(w for w, h in zip(weights, held, strict=True) if not h)
        above = [k for k, (z, w) in enumerate(zip(sizes, weights, strict=True)) if not held[k] and w * left > most * z * weight]
        if not above:
            return [float(most * z) if h else float(Fraction(w * left, weight)) for z, w, h in zip(sizes, weights, held, strict=True)]
        for k in above:
            held[k] = True
            left -= most * sizes[k]


class Draws:
    """Which blocks of which source stand in each shard.

    Of source s `quota[s]` blocks are taken in all. The shards are split in halves again and again: how many blocks of
    each source go to the first half is a multinomial draw (what is over a source's quota is drawn again among the
    others), with random numbers that only seed and halves determine. So any task can find the counts of any shard, and
    how many blocks of each source lie before it, without the others'.
    """

    def __init__(self, blocks: list[int], quota: list[int], seed: int = SEED, shard: int = SHARD):
        self.blocks, self.quota, self.seed, self.shard = np.array(blocks, np.int64), np.array(quota, np.int64), seed, shard
        self.total = int(self.quota.sum())
        self.shards = -(-self.total // shard)
        self._part = lru_cache(maxsize=256)(self._split)

    def __reduce__(self):
        return Draws, (self.blocks.tolist(), self.quota.tolist(), self.seed, self.shard)

    def _random(self, *keys: int) -> np.random.Generator:
        return np.random.Generator(np.random.Philox(np.random.SeedSequence([self.seed, *keys])))

    def _split(self, a: int, b: int) -> np.ndarray:
        """Counts by source of the first half of shards a .. b - 1, given those of all of them."""
        counts = self.of(a, b)[1]
        middle = (a + b) // 2
        missing, left = (middle - a) * self.shard, np.zeros_like(counts)
        random = self._random(0, a, b)
        while missing > 0:
            room = counts - left
            left += np.minimum(random.multinomial(missing, room / room.sum()), room)
            missing = (middle - a) * self.shard - int(left.sum())
        return left

    def of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """By source: blocks in the shards before a, and in the shards a .. b - 1, which must be one of the halves."""
        lo, hi, before, counts = 0, self.shards, np.zeros_like(self.quota), self.quota
        while (lo, hi) != (a, b):
            left, middle = self._part(lo, hi), (lo + hi) // 2
            if a < middle:
                hi, counts = middle, left
            else:
                lo, before, counts = middle, before + left, counts - left
        return before, counts

    def permuted(self, source: np.ndarray, turn: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The index's place in the source's pseudorandom permutation of its turn: four rounds of a Feistel network over
        the least even number of bits that holds the source's blocks, again where the result is beyond them."""
        n = self.blocks[source].astype(np.uint64)
        half = np.maximum(1, (np.ceil(np.log2(np.maximum(2, self.blocks))).astype(np.uint64)[source] + np.uint64(1)) // np.uint64(2))
        mask = (np.uint64(1) << half) - np.uint64(1)
        with np.errstate(over="ignore"):
            key = mix(mix(source.astype(np.uint64) + np.uint64(self.seed << 32)) + turn.astype(np.uint64))
        out, todo = index.astype(np.uint64), np.arange(len(index))
        while len(todo):
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                with np.errstate(over="ignore"):
                    left, right = right, left ^ (mix(right + mix(k + np.uint64(r))) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
        return out.astype(np.int64)

    def slots(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Source and block of each position of a shard. A source's blocks are all taken before any is taken again."""
        before, counts = self.of(shard, shard + 1)
        source = np.repeat(np.arange(len(counts)), counts)
        slot = before[source] + np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
        block = self.permuted(source, slot // self.blocks[source], slot % self.blocks[source])
        order = self._random(1, shard).permutation(len(source))
        return source[order], block[order]


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    words = F.length(F.translate(F.regexp_replace(text, _WORD, "x"), _BLANKS, "")).cast("long")
    return docs.select(docs[source_col].cast("string").alias("source"), docs[id_col].cast("long").alias("doc_id"), words.alias("size"), F.xxhash64(text).alias("tie"))


class Mix:
    """A mix of documents: `rows` (doc_id, source, size, source_size, target, rank, first), a row for each document,
    where `first` counts the words before it in its source; and `pieces`, what stands in the blocks.

    The words of a source, its documents in the order of their ids, are cut into blocks of BLOCK words; documents share
    blocks. The list of sources, a line each, goes through the driver, as a recipe does; of documents, words and blocks
    nothing does. A null text has no words; null is a source of its own, the last; documents of one id are each taken
    for themselves; columns but these three are ignored; an empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        self.spark, self.scratch, self.block = docs.sparkSession, Scratch(docs.sparkSession), block
        self._docs, self._names = docs, (id_col, text_col, source_col)
        sizes = self.scratch.table(_sizes(docs, id_col, text_col, source_col), "sizes")
        in_order = placed(sizes, [F.col("source").asc_nulls_last(), "doc_id", "size", "tie"], "size", self.scratch)
        known = in_order.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("start")).collect()
        known.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
        z = [r["source_size"] for r in known]
        self.targets = targets(z, [weights[k % len(weights)] for k in range(len(z))])
        blocks = [-(-x // block) for x in z]
        quota = [round(t * n / x) if x else 0 for t, n, x in zip(self.targets, blocks, z, strict=True)]
        self.draws = Draws(blocks, quota, seed, shard)
        recipe = self.spark.createDataFrame(
            [(r["source"], r["source_size"], t, k, r["start"]) for k, (r, t) in enumerate(zip(known, self.targets, strict=True))], "s string, source_size long, target double, rank int, start long"
        )
        rows = in_order.join(F.broadcast(recipe), F.col("source").eqNullSafe(F.col("s")))  # a row for each source
        self.rows = rows.select("doc_id", "source", "size", "source_size", "target", "rank", (F.col("before") - F.col("start")).alias("first"), "tie")

    def pieces(self) -> DataFrame:
        """rank, block, first, doc_id, start, length: the words start .. start + length - 1 of a document are in a block."""
        b, size = F.col("block"), self.block
        held = self.rows.filter("size > 0").select("rank", "first", "doc_id", "size", F.explode(F.expr(f"sequence(first div {size}, (first + size - 1) div {size})")).alias("block"))
        start = F.greatest(F.lit(0), b * size - F.col("first"))
        return held.select("rank", "block", "first", "doc_id", start.alias("start"), (F.least(F.col("size"), (b + 1) * size - F.col("first")) - start).alias("length"))

    def slots(self) -> DataFrame:
        """shard, position, rank, block: which block of which source stands where. A shard is drawn by one task alone."""
        draws = self.draws

        def run(batches):
            for batch in batches:
                for shard in batch["id"]:
                    rank, block = draws.slots(shard)
                    yield pd.DataFrame({"shard": shard, "position": np.arange(len(rank)), "rank": rank, "block": block})

        return self.spark.range(draws.shards).mapInPandas(run, "shard long, position int, rank int, block long")

    def mixed(self) -> DataFrame:
        """shard, position, rank, block, first, doc_id, start, length: slots and pieces joined by source and index."""
        # how many rows a drawn shard has isn't known beforehand: without the hint they could be taken for few, and broadcast
        return self.slots().hint("merge").join(self.pieces(), ["rank", "block"]).select("shard", "position", "rank", "block", "first", "doc_id", "start", "length")

    def texts(self) -> DataFrame:
        """shard, position, source, words, text: the mix itself, words joined by blanks."""
        id_col, text_col, source_col = self._names
        given = self._docs.select(self._docs[source_col].cast("string").alias("source"), self._docs[id_col].cast("long").alias("doc_id"), F.coalesce(self._docs[text_col].cast("string"), F.lit("")).alias("text"))
        given = given.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.expr("row_number() over (partition by source, doc_id, tie order by doc_id)"))
        rows = self.rows.filter("size > 0").withColumn("nth", F.expr("row_number() over (partition by source, doc_id, tie order by first)"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in ("source", "doc_id", "tie", "nth")]
        known = rows.alias("r").join(given.alias("g"), same).select("r.rank", "r.first", "r.source", "g.text")
        size = self.block

        def run(batches):
            for batch in batches:
                for rank, first, source, text in batch.itertuples(index=False):
                    words = [w for w in text.translate(_AS_BLANK).split(" ") if w]
                    for b in range(first // size, (first + len(words) - 1) // size + 1):
                        part = words[max(0, b * size - first) : (b + 1) * size - first]
                        yield pd.DataFrame({"rank": [rank], "block": [b], "first": [first], "source": [source], "words": [len(part)], "part": [" ".join(part)]})

        parts = known.mapInPandas(run, "rank int, block long, first long, source string, words int, part string")
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "part"))), lambda p: p["part"]), " ")
        blocks = parts.groupBy("rank", "block").agg(F.first("source").alias("source"), F.sum("words").alias("words"), text.alias("text"))
        return self.slots().hint("merge").join(blocks, ["rank", "block"]).select("shard", "position", "source", "words", "text")


_AS_BLANK = {ord(c): " " for c in _BLANKS}


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken: how many words of each document the mix takes, repeats counted."""
    made = Mix(docs)
    taken = made.mixed().groupBy("rank", "first").agg(F.sum("length").alias("taken"))
    rows = made.rows.withColumn("held", F.when(F.col("size") > 0, F.col("first")))
    found = rows.join(taken.toDF("r", "f", "taken").hint("merge"), (F.col("rank") == F.col("r")) & (F.col("held") == F.col("f")), "left")
    return found.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "source")
