"""Phrases by vertical positional inverted lists: frequent phrases grow by the next word, position joined with position."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bound_batches, frugal, give_back, lots
from .hashing import SpanHashes, mix, word_spans

#: Occurrences that make a phrase a candidate, words of the longest one, and phrases of a language that are reported.
LEAST, LONGEST, TOP = 30, 4, 2000
#: In per cent of a phrase's occurrences: where a longer phrase has as many, the shorter one goes.
ABSORBED = 80
#: Bytes of text of a block of positions: the lists of a block are extended by one task.
BLOCK_BYTES = 4_000_000
#: Bytes of text for which phrases to be counted get a fragment of their own.
FRAGMENT_BYTES = 16_000_000

_CUTS, _BLANKS = np.zeros(256, bool), np.zeros(256, bool)
_CUTS[list(b".,;:!?\n\x0b\x0c\r")] = True
_BLANKS[list(b" \t")] = True
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers, column by column, each as small as it can be."""
    parts = []
    for c in columns:
        kind = next(k for k, m in ((1, 2**7), (2, 2**15), (4, 2**31), (8, 2**63)) if not len(c) or max(int(c.max()), -int(c.min()) - 1) < m)
        parts.append(bytes([kind]) + len(c).to_bytes(8, "little") + c.astype(f"<i{kind}").tobytes())
    return _ZIP.compress(b"".join(parts))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = _UNZIP.decompress(data), 0, []
    while at < len(raw):
        kind, n = raw[at], int.from_bytes(raw[at + 1 : at + 9], "little")
        out.append(np.frombuffer(raw, f"<i{kind}", n, at + 9).astype(np.int64))
        at += 9 + kind * n
    return out


def _pack_lists(at: np.ndarray, ids: np.ndarray) -> bytes:
    return _pack(np.diff(at, prepend=0), ids)


def _unpack_lists(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, ids = _unpack(data)
    return np.cumsum(gaps), ids


def _pack_gids(first: int, step: int, gids: np.ndarray, increasing: np.ndarray, *others: np.ndarray) -> bytes:
    """The numbers that a fragment (its first number, and the step from one to the next) gave, and what they stand for."""
    return _pack(np.array([first, step]), np.diff((gids - first) // step, prepend=0), np.diff(increasing, prepend=0), *others)


def _unpack_gids(data: bytes) -> list[np.ndarray]:
    (first, step), gids, increasing, *others = _unpack(data)
    return [first + step * np.cumsum(gids), np.cumsum(increasing), *others]


def _word_list(data: bytes) -> list[bytes]:
    return _UNZIP.decompress(data).split(b"\n")


# --- blocks of positions ------------------------------------------------------------------------------------------------


class _Writer:
    """The words of one language in one task: their positions, one free between pieces, in blocks."""

    def __init__(self, lang: str, task: int):
        self.lang, self.task, self.blocks = lang, task, 0
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.gaps, self.words, self.size = [], [], {}, 0

    def add(self, data: np.ndarray) -> None:
        start, end = word_spans(data, _CUTS | _BLANKS)
        if not len(start):
            return
        key = SpanHashes(data)(start, end).view(np.int64)
        # a word begins a piece if a cut lies between it and the word before
        cuts = np.cumsum(_CUTS[data])
        new = np.concatenate([[True], cuts[start[1:]] != cuts[end[:-1] - 1]])
        unique, first = np.unique(key, return_index=True)
        raw = data.tobytes()
        for h, a, b in zip(unique.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            if h not in self.words:
                self.words[h] = raw[a:b]
        self.hashes.append(key)
        self.gaps.append(new)
        self.size += len(data)

    def flush(self, fragments: int):
        """The block's words by position, as numbers, and for each fragment its words with their numbers and counts."""
        if not self.hashes:
            return
        unique, local, count = np.unique(np.concatenate(self.hashes), return_inverse=True, return_counts=True)
        position = np.arange(len(local)) + np.cumsum(np.concatenate(self.gaps)) - 1
        block, words = self.task << 20 | self.blocks, self.words
        self.blocks += 1
        self._clear()
        yield block, self.lang, len(local), _pack_lists(position, local), None, None, None
        for f, own in _by_fragment((mix(unique.view(np.uint64)) % np.uint64(fragments)).astype(np.int64)):
            yield block, self.lang, None, None, f, _pack(own, count[own]), _ZIP.compress(b"\n".join(words[h] for h in unique[own].tolist()))


def _by_fragment(fragment: np.ndarray):
    """(fragment, places) for each fragment that there is."""
    order = np.argsort(fragment, kind="stable")
    cuts = np.flatnonzero(np.diff(fragment[order])) + 1
    for own in np.split(order, cuts):
        if len(own):
            yield int(fragment[own[0]]), own


_BLOCK = "block long, lang string, n long, positions binary, fragment long, numbers binary, words binary"


def _blocks(batches, size: int, fragments: int):
    from pyspark import TaskContext

    writers: dict[str, _Writer] = {}
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    names = [c.split()[0] for c in _BLOCK.split(", ")]

    def rows(full):
        for writer in full:
            found = list(writer.flush(fragments))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for lot in lots([batch], size // 4, 100_000):
            langs = np.array(lot.column("lang").to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                texts = [t.as_py().encode("utf-8", "surrogatepass") for t in lot.column("text").filter(pa.array(langs == lang))]
                if lang not in writers:
                    writers[lang] = _Writer(lang, TaskContext.get().partitionId() << 20 | len(writers))
                writers[lang].add(_FOLD[np.frombuffer(b"\n".join(texts), np.uint8)])  # texts end like pieces
                # a full block is written; of very many languages all are, before they fill the memory together
                crowded = sum(w.size for w in writers.values()) >= 4 * size
                yield from rows([w for w in writers.values() if crowded or w.size >= size])
    yield from rows(writers.values())


# --- lists of a block ---------------------------------------------------------------------------------------------------


def _place(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each value among the sorted distinct keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _gids(prefix: np.ndarray, word: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The table's (prefix, word, gid) gid of each pair, or -1."""
    prefixes, words = np.unique(table[0]), np.unique(table[1])
    key = _place(table[0], prefixes) * len(words) + _place(table[1], words)
    order = np.argsort(key)
    p, w = _place(prefix, prefixes), _place(word, words)
    at = _place(np.where((p >= 0) & (w >= 0), p * len(words) + w, -1), key[order])
    return np.where(at >= 0, table[2][order][at], -1) if len(order) else at


def _adjacent(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of two sorted lists of positions: the places in a and in b with b = a + step."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(b, a + step), len(b) - 1)
    hit = np.flatnonzero(b[at] == a + step)
    return hit, at[hit]


def _extended(lists, words, step: int):
    """Occurrences of phrases one word longer: places in the lists (position, phrase) whose phrase is followed by the
    word at `step`, and by an occurrence of another frequent phrase of the lists one position on."""
    (at, phrase), (word_at, word) = lists, words
    here, there = _adjacent(at, word_at, step)
    if step > 1:
        follows, _ = _adjacent(at, at, 1)
        both = np.isin(here, follows, assume_unique=True)
        here, there = here[both], there[both]
    return at[here], phrase[here], word[there]


def _fragment(prefix: np.ndarray, word: np.ndarray, fragments: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(mix(prefix.astype(np.uint64)) + word.astype(np.uint64)) % np.uint64(fragments)).astype(np.int64)


def _counted(prefix: np.ndarray, word: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (prefix, word) in order, and how often each occurs: the length of its list."""
    order = np.lexsort((word, prefix))
    prefix, word = prefix[order], word[order]
    start = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])])) if len(prefix) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(np.ones(len(prefix), np.int64) if times is None else times[order])])
    return prefix[start], word[start], np.diff(total[np.append(start, len(prefix))])


class Lists:
    """Positional inverted lists of frequent phrases, level by level, over blocks of positions.

    A block holds the postings of its words and of its frequent phrases. To extend the phrases by a word it merge-joins
    their positions with the postings one place further, and sends each extension with the length of its list, packed by
    fragment of the phrases' hash; a fragment sums the lengths of all blocks, which is the exact frequency, and answers
    each block with those of its phrases that are frequent. Fragments and blocks are many where there is much text, and
    a phrase is one entry a block, however frequent.
    """

    def __init__(self, docs: DataFrame, least: int, text_col: str, lang_col: str, block_bytes: int = BLOCK_BYTES):
        self.least, self.scratch = least, Scratch(docs.sparkSession)
        bound_batches(docs.sparkSession)
        given = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
        size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.fragments = fragments = max(16, -(-size // FRAGMENT_BYTES))
        blocks = self.scratch.table(given.mapInArrow(frugal(lambda b: _blocks(b, block_bytes, fragments)), _BLOCK), "blocks")
        #: lang, n: all words
        self.totals = blocks.filter("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))

        def count(df: pd.DataFrame) -> pd.DataFrame:
            sent = [(block, lang, *_unpack(numbers), _word_list(words)) for block, lang, numbers, words in zip(df["block"], df["lang"], df["numbers"], df["words"], strict=True)]
            total: dict[tuple[str, bytes], int] = {}
            for _, lang, _, n, words in sent:
                for w, k in zip(words, n.tolist(), strict=True):
                    total[lang, w] = total.get((lang, w), 0) + k
            often = sorted(w for w, k in total.items() if k >= least)
            first = int(df["fragment"].iloc[0])
            gid = {w: first + fragments * k for k, w in enumerate(often)}
            out = [(None, lang, w.decode("utf-8", "surrogatepass"), total[lang, w], gid[lang, w], None) for lang, w in often]
            for block, lang, local, _, words in sent:
                got = np.array([gid.get((lang, w), -1) for w in words], np.int64)
                if (got >= 0).any():
                    out.append((block, None, None, None, None, _pack_gids(first, fragments, got[got >= 0], local[got >= 0])))
            return give_back(pd.DataFrame(out, columns=["block", "lang", "word", "f", "gid", "found"]).astype({"block": "Int64", "f": "Int64", "gid": "Int64"}))

        sent = blocks.filter("fragment is not null").select("fragment", "block", "lang", "numbers", "words")
        answers = self.scratch.table(sent.groupBy("fragment").applyInPandas(count, "block long, lang string, word string, f long, gid long, found binary"), "words")
        #: lang, word, f, gid of the frequent words
        self.words = answers.filter("block is null").select("lang", "word", "f", "gid")
        found = answers.filter("block is not null").select(F.col("block").alias("of"), "found")
        postings = blocks.filter("n is not null").select("block", "positions").groupBy("block").cogroup(found.groupBy("of")).applyInPandas(_start, _STATE)
        self.state = self.scratch.table(postings, "lists")

    def level(self, length: int) -> DataFrame:
        """prefix, word, gid, a: the frequent phrases of that many words; one call for each length from 2 on."""
        step, fragments, least = length - 1, self.fragments, self.least

        def send(batches):
            for batch in batches:
                for row in batch.itertuples(index=False):
                    words = _unpack_lists(row.words)
                    _, prefix, word = _extended(words if row.lists is None else _unpack_lists(row.lists), words, step)
                    prefix, word, n = _counted(prefix, word)
                    each = _by_fragment(_fragment(prefix, word, fragments))
                    yield give_back(pd.DataFrame([(f, row.block, _pack(np.diff(prefix[o], prepend=0), word[o], n[o])) for f, o in each], columns=["fragment", "block", "phrases"]))

        def count(df: pd.DataFrame) -> pd.DataFrame:
            sent = [_unpack(p) for p in df["phrases"]]
            prefix, word, n = (np.concatenate([s[k] if k else np.cumsum(s[0]) for s in sent]) for k in range(3))
            all_prefix, all_word, a = _counted(prefix, word, n)
            kept = a >= least
            all_prefix, all_word, a = all_prefix[kept], all_word[kept], a[kept]
            first = int(df["fragment"].iloc[0])
            gid = first + fragments * np.arange(len(a))
            out = [(None, _pack(all_prefix, all_word, gid, a))] if len(a) else []
            for block, (p, w, _) in zip(df["block"], sent, strict=True):
                p = np.cumsum(p)
                got = _gids(p, w, (all_prefix, all_word, gid))
                if (got >= 0).any():
                    out.append((block, _pack_gids(first, fragments, got[got >= 0], p[got >= 0], w[got >= 0])))
            return give_back(pd.DataFrame(out, columns=["block", "phrases"]).astype({"block": "Int64"}))

        sent = self.state.mapInPandas(send, "fragment long, block long, phrases binary")
        answers = self.scratch.table(sent.groupBy("fragment").applyInPandas(count, "block long, phrases binary"), "answers")
        if length < LONGEST:
            here = self.state.groupBy("block").cogroup(answers.filter("block is not null").select(F.col("block").alias("of"), "phrases").groupBy("of"))
            self.state = self.scratch.table(here.applyInPandas(lambda own, got: _grown(own, got, step), _STATE), "lists")

        def rows(batches):
            for batch in batches:
                for data in batch["phrases"]:
                    yield pd.DataFrame(dict(zip(("prefix", "word", "gid", "a"), _unpack(data), strict=True)))

        return self.scratch.table(answers.filter("block is null").select("phrases").mapInPandas(rows, "prefix long, word long, gid long, a long"), "phrases")


_STATE = "block long, lists binary, words binary"
_NOTHING = pd.DataFrame({"block": [], "lists": [], "words": []})


def _start(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The postings of the frequent words of a block. They are its phrases of one word too: no lists of their own."""
    if not len(found):
        return _NOTHING
    at, local = _unpack_lists(own["positions"].iloc[0])
    gid = np.full(int(local.max()) + 1, -1)
    for data in found["found"]:
        got, number = _unpack_gids(data)
        gid[number] = got
    word = gid[local]
    return give_back(pd.DataFrame({"block": [own["block"].iloc[0]], "lists": [None], "words": [_pack_lists(at[word >= 0], word[word >= 0])]}))


def _grown(own: pd.DataFrame, got: pd.DataFrame, step: int) -> pd.DataFrame:
    """The lists of the frequent phrases one word longer, and the postings of words that may follow these."""
    if not len(got) or not len(own):
        return _NOTHING
    word_at, words = _unpack_lists(own["words"].iloc[0])
    lists = own["lists"].iloc[0]
    at, prefix, word = _extended((word_at, words) if lists is None else _unpack_lists(lists), (word_at, words), step)
    known, prefixes, nexts = (np.concatenate(c) for c in zip(*map(_unpack_gids, got["phrases"]), strict=True))
    phrase = _gids(prefix, word, (prefixes, nexts, known))
    at, phrase = at[phrase >= 0], phrase[phrase >= 0]
    follow, _ = _adjacent(word_at, at + step + 1, 0)
    return give_back(pd.DataFrame({"block": [own["block"].iloc[0]], "lists": [_pack_lists(at, phrase)], "words": [_pack_lists(word_at[follow], words[follow])]}))


# --- phrases ------------------------------------------------------------------------------------------------------------


def _spelt(lists: Lists) -> list[DataFrame]:
    """For each length from 1 on: lang, p (the words), a."""
    words = lists.words.select("lang", "word", F.col("gid").alias("w"), "f")
    out = [words.select("lang", F.array("word").alias("p"), F.col("f").alias("a"))]
    before = words.select(F.col("w").alias("prefix"), "lang", F.array("word").alias("p"))
    for length in range(2, LONGEST + 1):
        found = lists.level(length).join(words.select(F.col("w").alias("word"), F.col("word").alias("spelt")), "word").join(before, "prefix")
        spelt = lists.scratch.table(found.select("gid", "lang", F.concat("p", F.array("spelt")).alias("p"), "a"), "spelt")
        out.append(spelt.select("lang", "p", "a"))
        before = spelt.select(F.col("gid").alias("prefix"), "lang", "p")
    return out


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int | None = TOP, text_col: str = "text", lang_col: str = "lang", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to 4 words that occur `least` times or more in a
    language, and are not mostly part of a longer one.

    a, l and r are exact frequencies (lengths of lists), of the phrase and of the parts of its lowest-scoring cut, n the
    language's words; arithmetic is in decimals of 38 digits. A null text is empty, a null language `und`; repeated rows
    count as often as they stand there; other columns are ignored, ids too; an empty table gives an empty result. With
    top=None all phrases are reported. Phrases are compared as UTF-8 bytes.
    """
    lists = Lists(docs, least, text_col, lang_col, block_bytes)
    each = _spelt(lists)
    known = reduce(DataFrame.unionByName, each)
    candidates = reduce(DataFrame.unionByName, each[1:])

    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.struct(k.alias("k"), F.slice("p", F.lit(1), k).alias("first"), F.slice("p", k + 1, F.size("p") - k).alias("rest"))))
    cut = candidates.select("lang", "p", "a", cuts.alias("c")).select("lang", "p", "a", "c.k", "c.first", "c.rest")
    parts = lambda name, f: known.select("lang", F.col("p").alias(name), F.col("a").alias(f))
    scored = cut.join(parts("first", "l"), ["lang", "first"]).join(parts("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(8, 0))) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    scored = scored.groupBy("lang", "p", "a").agg(lowest).select("lang", "p", "a", "m.l", "m.r", "m.score")

    # what lies in a candidate two words longer lies, as often at least, in one that is one word longer
    longer = reduce(DataFrame.unionByName, each[2:]) if len(each) > 2 else candidates.limit(0)
    inside = longer.select("lang", F.explode(F.array(F.expr("slice(p, 1, size(p) - 1)"), F.expr("slice(p, 2, size(p) - 1)"))).alias("p"), "a")
    most = inside.groupBy("lang", "p").agg(F.max("a").alias("most"))
    kept = scored.join(most, ["lang", "p"], "left").filter(F.expr(f"most IS NULL OR CAST(most AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {ABSORBED}"))
    named = kept.join(F.broadcast(lists.totals), "lang").withColumn("phrase", F.array_join("p", " "))  # a row for each language
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= top) if top else ranked
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
