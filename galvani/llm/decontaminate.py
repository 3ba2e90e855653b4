"""Benchmark decontamination: CGK walks embed windows of words, bit-sampling finds candidates, edit distance decides."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, id_and_text, lots
from .hashing import SpanHashes, mix, word_spans

#: Edits (words put in, left out or replaced) that a copy of an item may have, as a share of the item's words.
EDITS = 0.2
#: Walks, samples of each walk for a window size, and steps of a sample. A sample agrees where no sampled step of the
#: two walks differs; WALKS * SAMPLES of them are tried, so that copies with EDITS edits are found (see the tests).
WALKS, SAMPLES, STEPS = 7, 3, 5
#: Window sizes in words, from how many words on an item has windows of that size, and at every how many words of a
#: document such windows start. An item has the largest size that it is long enough for, so several windows even after
#: EDITS edits, all along it. A walk takes about two steps for a word.
LEAST_WORDS = {1: 1, 2: 2, 4: 8, 8: 12, 16: 28, 32: 64}
STRIDES = {1: 1, 2: 1, 4: 2, 8: 4, 16: 8, 32: 8}
STRIDE = max(STRIDES.values())
SIZES = tuple(STRIDES)
#: Items of which windows have this size at most may have no edit, so that one walk finds all.
EXACT = 2
#: Bytes of benchmark text that are searched for at once; a larger benchmark is searched for in blocks.
BLOCK_BYTES = 4_000_000
#: Bytes of documents that are embedded at once.
LOT_BYTES = 1_000_000

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)], np.uint8)
_BLANK = np.arange(256) == 32

SCHEMA = "doc_id long, item_id long, start_word long, end_word long, edits long, item_words long"


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of letters, digits and what isn't ASCII, in lower case) and each text's first."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(b" ".join(raw), np.uint8)]
    start, end = word_spans(data, _BLANK)
    first = np.cumsum([0] + [len(r) + 1 for r in raw])
    return (SpanHashes(data)(start, end) | np.uint64(1)) if len(start) else np.zeros(0, np.uint64), np.searchsorted(start, first)


@dataclass
class Plan:
    """The walks' random numbers, and the sampled steps by walk, window size and sample."""

    sizes: list[int]
    multipliers: np.ndarray
    steps: dict[tuple[int, int, int], np.ndarray]


def make_plan(sizes: list[int]) -> Plan:
    random = np.random.default_rng(5)
    multipliers = random.integers(0, 2**31, (WALKS, 2 * max(SIZES)), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    steps = {}
    for r in range(WALKS):
        for size in SIZES:
            most = size if size <= EXACT else round(1.4 * size)
            for z in range(SAMPLES):
                steps[r, size, z] = np.sort(random.choice(most, min(STEPS, most), replace=False))
    return Plan(sizes, multipliers, steps)


def keys(words: np.ndarray, starts: np.ndarray, plan: Plan, sizes: list[int]) -> dict[tuple[int, int, int], np.ndarray]:
    """For each walk, window size and sample a key for each start. words: 32 bits each, 0 past a text's end.

    A CGK walk reads the word under its pointer and moves on or stays, as a hash of step and word says. Walks over
    two texts that differ by edits fall in step again, so the edit distance bounds how many of their steps differ.
    """
    out = {}
    with np.errstate(over="ignore"):
        for r in range(WALKS):
            at = starts.copy()
            mine = {(size, z): plan.steps[r, size, z] for size in sizes for z in range(SAMPLES) if size > EXACT or r == z == 0}
            if not mine:
                break
            sums = {k: np.full(len(starts), (r << 16) + (k[0] << 4) + k[1], np.uint64) for k in mine}
            for j in range(1 + max(s[-1] for s in mine.values())):
                c = words[at]
                for k, s in mine.items():
                    if j in s:
                        sums[k] = (sums[k] + c) * np.uint64(0x9E3779B97F4A7C15)
                at += (c * plan.multipliers[r, j]) >> np.uint32(31)
            out |= {(r, *k): mix(v) for k, v in sums.items()}
    return out


def edit_distance_within(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of the item to any stretch of the region, and that stretch's start and end."""
    n = len(region) + 1
    at = np.arange(n)
    row, origin = np.zeros(n, np.int64), at.copy()
    for i, w in enumerate(item, 1):
        # distance * 2^32 + place where the stretch began: the least of both at once
        packed = (row << 32) + origin
        new = packed + (1 << 32)
        new[1:] = np.minimum(new[1:], packed[:-1] + ((region != w).astype(np.int64) << 32))
        new = np.minimum.accumulate(new - (at << 32)) + (at << 32)
        row, origin = new >> 32, new & 0xFFFFFFFF
        row[0], origin[0] = i, 0
    end = int(np.argmin(row))
    return int(row[end]), int(origin[end]), end


class Index:
    """A block of items, by the keys of their windows."""

    def __init__(self, items: list[tuple[int, str | None]]):
        hashes, first = words_of([t for _, t in items])
        self.items = [(i, hashes[a:b]) for (i, _), a, b in zip(items, first, first[1:], strict=False) if b > a]
        self.wanted = [w.tolist() for _, w in self.items]
        size = [max(s for s, least in LEAST_WORDS.items() if len(w) >= least) for _, w in self.items]
        self.plan = make_plan(sorted(set(size)))
        pad = np.zeros(2 * max(SIZES) + 1, np.uint64)
        flat = np.concatenate([np.concatenate([w, pad]) for _, w in self.items]) if self.items else pad
        begin = np.cumsum([0] + [len(w) + len(pad) for _, w in self.items])[:-1]
        found = []
        for s in self.plan.sizes:
            # windows end to end along the item and one at its end, each from every place where a document's may fall
            tiles = [(o, t + j) for o, (_, w) in enumerate(self.items) if size[o] == s for t in self._tiles(len(w), s) for j in range(STRIDES[s])]
            owner, shift = np.array(tiles, np.int64).T
            found += [(k, owner, shift) for k in keys(narrow(flat), begin[owner] + shift, self.plan, [s]).values()]
        key, self.owner, self.shift = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 3
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.shift = key[order], self.owner[order], self.shift[order]
        self.bits = np.zeros(1 << 22, bool)  # most windows go no further than this
        self.bits[(self.key & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    @staticmethod
    def _tiles(length: int, size: int) -> list[int]:
        last = length - size - STRIDES[size] + 1
        return sorted({*range(0, last + 1, size), last})

    def candidates(self, words: np.ndarray, first: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, expected place of the item's first word in the text) of windows that share a key with an item."""
        count = np.diff(first)
        pad = 2 * max(SIZES) + 1
        begin = first[:-1] + pad * np.arange(len(count))
        flat = np.zeros(len(words) + pad * len(count), np.uint64)
        flat[np.arange(len(words)) + pad * np.repeat(np.arange(len(count)), count)] = words
        flat, out = narrow(flat), set()
        for stride in sorted({STRIDES[s] for s in self.plan.sizes}):
            windows = -(-count // stride)
            text = np.repeat(np.arange(len(count)), windows)
            place = (np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)) * stride
            for k in keys(flat, begin[text] + place, self.plan, [s for s in self.plan.sizes if STRIDES[s] == stride]).values():
                hit = np.flatnonzero(self.bits[(k & np.uint64((1 << 22) - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(self.key, k[hit], "left"), np.searchsorted(self.key, k[hit], "right")
                for w, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    out.update((int(text[w]), int(o), int(place[w] - s)) for o, s in zip(self.owner[a:b], self.shift[a:b], strict=True))
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item_id, start, end, edits, words of the item): the best place of each item that a text holds a copy of."""
        words, first = words_of(texts)
        if not len(words) or not self.items:
            return []
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for text, item, at in sorted(self.candidates(words, first)):
            _, want = self.items[item]
            most = int(EDITS * len(want))
            slack = most + STRIDE
            if (text, item, at // (slack + 1)) in tried:
                continue
            tried.add((text, item, at // (slack + 1)))
            at = at // (slack + 1) * (slack + 1)
            own = words[first[text] : first[text + 1]]
            lo, hi = max(0, at - slack), max(0, at + len(want) + 2 * slack + 1)
            there = set(own[lo:hi].tolist())
            if sum(w in there for w in self.wanted[item]) < len(want) - most:
                continue  # so many of its words are not there at all
            edits, a, b = edit_distance_within(want, own[lo:hi])
            if edits <= most:
                best[text, item] = min(best.get((text, item), (edits, lo + a, lo + b)), (edits, lo + a, lo + b))
        return [(t, self.items[i][0], a, b, e, len(self.items[i][1])) for (t, i), (e, a, b) in sorted(best.items())]


def narrow(words: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash; the end of a text stays 0."""
    return (words >> np.uint64(32)).astype(np.uint32)


def _search(batches, index: Index):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in lots(batches, LOT_BYTES):
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[t], *rest) for t, *rest in index.matches([x.as_py() for x in batch.column("text")])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True)) or [()] * 6], names)


def _indexes(benchmark: DataFrame, block_bytes: int):
    """The items in blocks of about `block_bytes`, by a hash; a block is gathered and goes to all tasks, one at a time."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield Index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))), block + 1 == blocks


def find_benchmark_copies(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits, item_words: every item of which a document holds a copy, with its
    best place there in words (of equally good ones the first).

    A copy has EDITS of the item's words as edits at most. A block of items is one pass over the documents without a
    shuffle; of several blocks each pass is written before the next block is gathered. Null and empty texts, on either side, have no words and match nothing; a null id stays null; repeated
    rows give repeated results; empty tables give an empty result; other columns are ignored.
    """
    known = id_and_text(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    found = []
    for index, last in _indexes(benchmark, block_bytes):
        part = known.mapInArrow(frugal(lambda b, index=index: _search(b, index)), SCHEMA)
        found.append(part if last and not found else scratch.table(part, "block"))
    return reduce(DataFrame.unionByName, found)


def _clean(batches, index: Index):
    for batch in lots(batches, LOT_BYTES):
        keep = np.ones(batch.num_rows, bool)
        keep[[t for t, *_ in index.matches([x.as_py() for x in batch.column("text")])]] = False
        yield batch.filter(pa.array(keep))


def drop_benchmark_copies(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no copy of any item; as find_benchmark_copies, without a shuffle."""
    scratch = Scratch(docs.sparkSession)
    for index, last in _indexes(benchmark, block_bytes):
        docs = docs.mapInArrow(frugal(lambda b, index=index: _clean(b, index)), docs.schema)
        docs = docs if last else scratch.table(docs, "clean")
    return docs
