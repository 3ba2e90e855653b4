"""Packing: documents become token sequences of a fixed window by best-fit decreasing."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from base64 import b64decode
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import frugal, id_and_text

WINDOW = 1024
END_ID = 0
#: Documents whose last pieces are packed together: bounds a task's memory, whatever the partition's size.
LOT = 50_000
VOCABULARY = "byte_bpe_50k"
#: Blanks in a row from which a text goes through `tokenizers`: tiktoken's expression runs out of stack at about 10^6.
LONG_BLANK = 100_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """A segment tree over the remaining capacities 0..window; a node holds how many open windows lie below it."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.count = [0] * (2 * self.base)
        self.at: list[list] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = self.base + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def push(self, capacity: int, window_id: int) -> None:
        self.at[capacity].append(window_id)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out an open window of the least capacity that is at least `need`."""
        i = self.base + need
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):  # up to where a tree to the right holds a window
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:  # down to its leftmost
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.base
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[tuple[int, int]], int]:
    """For each piece its window's number and its offset there, and the count of windows."""
    open_windows, place, n = OpenWindows(window), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = open_windows.tightest(lengths[k])
        if found is None:
            found, n = (window, n), n + 1
        capacity, at = found
        place[k] = (at, window - capacity)
        if capacity > lengths[k]:
            open_windows.push(capacity - lengths[k], at)
    return place, n


@lru_cache(2)
def encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@lru_cache(2)
def whole_encoder(vocabulary: str):
    """The same vocabulary in `tokenizers`: slower, but text of any shape passes."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def encode(text: str | None, vocabulary: str = VOCABULARY) -> array:
    """The ids of the whole text, as `tokenizers` gives them: a string of an added token has that token's id."""
    if text and len(text) >= LONG_BLANK and max((m.end() - m.start() for m in re.finditer(r"\s+", text)), default=0) >= LONG_BLANK:
        return array("I", whole_encoder(vocabulary).encode(text, add_special_tokens=False).ids)
    return array("I", encoder(vocabulary).encode(text, allowed_special="all") if text else ())


def _pack(batches, window: int, lot: int, vocabulary: str):
    # Each task packs what it reads, so nothing is shuffled; its number keeps the tasks' sequences apart.
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    docs = []

    def packed():
        nonlocal first
        rows, tails = [], []
        for doc_id, total, crcs in docs:
            for k, crc in enumerate(crcs):
                start = k * window
                rows.append([doc_id, start, min(window, total - start), crc, total, 0, 0])
                if rows[-1][2] == window:
                    rows[-1][5] = first
                    first += 1
                else:
                    tails.append(len(rows) - 1)
        place, n = best_fit_decreasing([rows[k][2] for k in tails], window)
        for k, (at, offset) in zip(tails, place, strict=True):
            rows[k][5:] = [first + at, offset]
        first += n
        docs.clear()
        for at in range(0, len(rows), 100_000):
            columns = zip(*rows[at : at + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in SCHEMA.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py(), vocabulary)
            ids.append(END_ID)
            held = memoryview(ids).cast("B")
            docs.append((doc_id, len(ids), [zlib.crc32(held[4 * k : 4 * (k + window)]) for k in range(0, len(ids), window)]))
            if len(docs) >= lot:
                yield from packed()
    if docs:
        yield from packed()


def pack_documents(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, lot: int = LOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    A document is its token ids and then id 0. Overlong documents are first cut into full windows, each a sequence
    of its own; what is left of each document goes, longest first, into the open window that it fills best. Tasks
    pack on their own in lots of `lot` documents, so the job has no shuffle, and the windows that stay open are a
    few for each lot.

    A null text is empty: a piece of one id. A null id is kept; repeated rows are packed each for itself; equal
    lengths go by their order in the task; an empty table gives an empty result; other columns are ignored.
    """
    return id_and_text(docs, id_col, text_col).mapInArrow(frugal(lambda batches: _pack(batches, window, lot, vocabulary)), SCHEMA)
