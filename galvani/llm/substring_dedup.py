"""Substring dedup: passages that repeat across documents, by MinHash bands of paragraphs and exact Jaccard similarity.

Paragraphs are lines. Near copies among them are found by MinHash bands, tuned to a recall, and settled by the exact
similarity of their shingles. A passage may also stand inside a paragraph or go over several: so each text is cut into
short pieces as well, at places that the words themselves choose, and equal pieces are such a passage's seeds. What is
found grows word by word to both sides as far as the kept copy agrees, so that whole passages are told, not pieces.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, frugal
from .hashing import SPACE, SpanHashes, mix, span_hashes, word_spans
from .setjoin import BITS, bits_of, similar_components

#: A piece starts at the least hash of each SPREAD pairs of words in a row, and has LEAST_PIECE words or more. Any copy
#: of 2 * SPREAD + LEAST_PIECE words, 51, so holds a whole piece that is the same in both documents.
SPREAD, LEAST_PIECE = 22, 7
#: Words of a paragraph that is compared for near copies; and of what is reported, unless it is all of its text.
LEAST_PARAGRAPH, LEAST_WORDS = 12, 32
#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 75
#: Rows of a band, and the share of pairs at the least similarity that some band must bring together.
ROWS, RECALL = 3, 0.95
#: Contents of which one in HOT places or more is one; there are HOT of them at most, and they go to all tasks.
HOT = 4096
#: Bytes of text that are hashed at once.
LOT_BYTES = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.uint64)
_LOW32 = np.uint64(2**32 - 1)


def bands_for(recall: float = RECALL, percent: int = PERCENT, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that bring together that share of pairs with just the least similarity."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Lot:
    """The words of some texts, and the pieces and paragraphs made of them, as ranges of words [a, b)."""

    def __init__(self, texts: list[str | None], spread: int = SPREAD, least: int = LEAST_PIECE):
        self.spread, self.least = spread, least
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = _LOWER[np.frombuffer(b" ".join(raw), np.uint8)]
        offset = np.cumsum([0] + [len(r) + 1 for r in raw])
        start, end = word_spans(data, SPACE)
        self.hashes = SpanHashes(data)(start, end) if len(start) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(start, offset)  # each text's first word, and the end
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        points = np.cumsum((data & 0xC0) != 0x80)
        before = np.append(0, points)[offset[:-1]][self.text] if len(start) else np.zeros(0, np.int64)
        self.start, self.end = (points[start] - 1 - before, points[end - 1] - before) if len(start) else (before, before)  # code points
        self.line = np.searchsorted(np.flatnonzero(data == 10), start)
        self.spans = span_hashes(self.hashes)

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Every word is in a piece; short ones reach into the next; a text of few words is one."""
        n, spread, least = len(self.hashes), self.spread, self.least
        cuts = self.first[:-1][self.count > 0]
        if n > spread:
            pair = mix(self.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:]) >> np.uint64(32)
            pair[1:][(pair[1:] == pair[:-1]) & (self.text[1:-1] == self.text[:-2])] = _LOW32  # of a run of one word only the first pair counts
            low = (pair << np.uint64(32)) + (_LOW32 - np.arange(n - 1, dtype=np.uint64))
            span = 1
            while span < spread:  # least of 2, 4, 8, ... places; of equal ones the rightmost
                shift = min(span, spread - span)
                low, span = np.minimum(low[:-shift], low[shift:]), span + shift
            low = low[self.text[: len(low)] == self.text[spread:][: len(low)]]
            low = low[(low >> np.uint64(32)) < _LOW32]
            cuts = np.union1d(cuts, (_LOW32 - (low & _LOW32)).astype(np.int64))
        if not len(cuts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = self.first[1:][self.text[cuts]]  # the end of the cut's text
        ends = np.union1d(cuts[cuts <= last - least], self.first[1:])
        b = np.minimum(ends[np.searchsorted(ends, np.minimum(cuts + least, last))], last)
        keep = (b - cuts >= least) | (cuts == self.first[:-1][self.text[cuts]])
        return cuts[keep], b[keep]

    def paragraphs(self, least: int = LEAST_PARAGRAPH) -> tuple[np.ndarray, np.ndarray]:
        """Lines of `least` words or more."""
        a = np.flatnonzero(_changes(self.text, self.line)) if len(self.text) else np.zeros(0, np.int64)
        b = np.append(a[1:], len(self.text))
        return a[b - a >= least], b[b - a >= least]

    def shingles(self) -> np.ndarray:
        """At each word the hash of SHINGLE words from there; paragraphs have more than that."""
        at = np.arange(max(0, len(self.hashes) - SHINGLE + 1))
        return self.spans(at, at + SHINGLE)

    def band_keys(self, a: np.ndarray, b: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
        """A row of band keys for each paragraph [a, b)."""
        shingles = self.shingles()
        ranges = np.stack([a, b - SHINGLE + 1], 1).ravel()
        keys = np.empty((len(a), bands), np.int64)
        with np.errstate(over="ignore"):
            for band in range(bands):
                key = np.full(len(a), band, np.uint64)
                for r in range(rows):
                    mixed = np.append(mix(shingles ^ _SEEDS[band * rows + r]), np.uint64(0))
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mixed, ranges)[::2])
                keys[:, band] = key.astype(np.int64)
        return keys


def _lots(batches, *columns: str):
    """Some rows at a time: their texts, and the values of the columns."""
    for batch in batches:
        held = [batch.column(c).to_pylist() for c in columns]
        lot, size, at = [], 0, 0
        for k, text in enumerate(batch.column("text")):
            lot.append(text.as_py())
            size += len(lot[-1] or "")
            if size >= LOT_BYTES or k + 1 == batch.num_rows:
                yield lot, *(h[at : k + 1] for h in held)
                lot, size, at = [], 0, k + 1


def _place_schema(bands: int) -> str:
    return "content long, doc_id long, w0 int, w1 int, words int, " + ", ".join(f"k{j} long" for j in range(bands))


def _places(batches, bands: int):
    """All pieces and paragraphs: hash of the words, place in words, words of the text, and band keys."""
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, *[pa.int64()] * bands]
    names = [c.split()[0] for c in _place_schema(bands).split(", ")]
    for texts, ids in _lots(batches, "doc_id"):
        lot = Lot(texts)
        if not len(lot.hashes):
            continue
        a, b = lot.paragraphs()
        keys = lot.band_keys(a, b, bands) if len(a) else np.zeros((0, bands), np.int64)
        # a piece that is a paragraph too is one place
        pa_, pb = lot.pieces()
        other = ~np.isin(pa_ * (len(lot.hashes) + 1) + pb, a * (len(lot.hashes) + 1) + b)
        banded = np.arange(len(a) + other.sum()) < len(a)
        a, b = np.concatenate([a, pa_[other]]), np.concatenate([b, pb[other]])
        text = lot.text[a]
        missing = np.array([i is None for i in ids])[text]
        doc_id = np.array([0 if i is None else i for i in ids], np.int64)[text]
        keys = np.concatenate([keys, np.zeros((int(other.sum()), bands), np.int64)])
        head = lot.first[:-1][text]
        columns = [lot.spans(a, b).astype(np.int64), pa.array(doc_id, mask=missing), a - head, b - head, lot.count[text]]
        columns += [pa.array(keys[:, j], mask=~banded) for j in range(bands)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names)


SETS = "id long, hashes array<long>, first array<int>, last array<int>"


def _wanted_sets(batches):
    """The wanted paragraphs of the texts: their shingles, each once, and where each stands first and last."""
    for texts, wanted in _lots(batches, "wanted"):
        lot = Lot(texts)
        a, b = lot.paragraphs()
        content = lot.spans(a, b).astype(np.int64)
        content, once = np.unique(content, return_index=True)
        keep = np.isin(content, np.array([c for w in wanted for c in w], np.int64))
        content, a, b = content[keep], a[once][keep], b[once][keep]
        length = b - a - SHINGLE + 1
        owner = np.repeat(np.arange(len(a)), length)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        shingles = lot.shingles()[at + np.repeat(a, length)]
        order = np.lexsort((at, shingles, owner))
        owner, shingles, at = owner[order], shingles[order], at[order]
        new = _changes(owner, shingles)
        old = np.append(new[1:], True)[: len(new)]  # the last of its kind
        edges = pa.array(np.searchsorted(owner[new], np.arange(len(a) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x, k)) for x, k in ((shingles[new].astype(np.int64), pa.int64()), (at[new], pa.int32()), (at[old], pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), *lists], ["id", "hashes", "first", "last"])


CONTEXTS = "doc_id long, at int, side int, here int, words array<int>, points array<int>"


def _contexts(batches):
    """For each wanted place and side the SPREAD words beside it (side 0: before, 1: behind), nearest first: 32 bits of
    their hashes, and their outer ends in code points, as is `here` of the place."""
    for texts, ids, wanted in _lots(batches, "doc_id", "wanted"):
        lot = Lot(texts)
        rows = [(ids[k], w["at"], w["side"], lot.first[k] + w["at"], lot.first[k], lot.first[k + 1]) for k, ws in enumerate(wanted) for w in ws if w["at"] <= lot.count[k]]
        doc, at, side, here, lo, hi = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 6))
        length = np.where(side == 1, np.minimum(hi - here, lot.spread), np.minimum(here - lo, lot.spread))
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        behind = np.repeat(side == 1, length)
        place = np.repeat(here, length) + np.where(behind, step, -1 - step)
        point = np.where(side == 1, lot.end[np.maximum(here - 1, 0)], lot.start[np.minimum(here, len(lot.start) - 1)]) if len(here) else here
        words = (lot.hashes[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        points = np.where(behind, lot.end[place], lot.start[place]).astype(np.int32)
        edges = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in (words, points)]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at, pa.int32()), pa.array(side, pa.int32()), pa.array(point, pa.int32()), *lists], [c.split()[0] for c in CONTEXTS.split(", ")])


def _near_components(places: DataFrame, known: DataFrame, low: DataFrame, bands: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component, lead, tail) of the paragraphs' contents that are near copies of another; in [lead, tail) are
    all words that any of those compared has too.

    A content is one row before its bands are dealt out, however often it stands. Contents that share a band with
    another are compared by the exact Jaccard similarity of their shingles: those that share one of their rarest
    (prefixes of the order of shingles by frequency), as all pairs of a band could be the square of a large family.
    """
    lines = places.filter("k0 is not null").groupBy("content").agg(*[F.min(f"k{j}").alias(f"k{j}") for j in range(bands)])
    rows = lines.select(F.col("content").alias("id"), F.explode(F.array(*[f"k{j}" for j in range(bands)])).alias("key"))
    by_key = Window.partitionBy("key")
    met = rows.withColumns({"least": F.min("id").over(by_key), "most": F.max("id").over(by_key)}).filter("least < most")
    met = scratch.table(met.select("id").distinct(), "met")

    # the text of one document for each content to be compared
    holders = low.join(met.withColumnRenamed("id", "content"), "content", "left_semi").filter("low is not null")
    holders = holders.groupBy(F.col("low").alias("doc_id")).agg(F.collect_list("content").alias("wanted"))
    sets = known.join(holders, "doc_id").select("text", "wanted").mapInArrow(frugal(_wanted_sets), SETS).dropDuplicates(["id"])
    sets = scratch.table(sets.select("id", F.size("hashes").alias("n"), F.arrays_zip("hashes", "first", "last").alias("entries")), "sets")

    entries = sets.select("id", "n", F.explode("entries").alias("e")).select("id", "n", F.col("e.hashes").alias("shingle"), "e.first", "e.last")
    seen = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1")
    shared = entries.join(seen, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("seen", "shingle"))).alias("x"), F.min("first").alias("lead"), (F.max("last") + SHINGLE).alias("tail"), *bits_of("shingle"))
    shared = shared.select("id", "n", F.size("x").alias("s"), F.transform("x", lambda e: e["shingle"]).alias("hashes"), "lead", "tail", *BITS)
    # what only one set has comes first in the order; a set of which that fills the prefix has no partner
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1 - (F.col("n") - F.col("s"))
    shared = scratch.table(shared.withColumn("prefix", prefix.cast("int")).filter("prefix > 0"), "shared")
    postings = shared.select("id", "n", "s", F.posexplode(F.slice("hashes", 1, F.col("prefix"))))
    postings = postings.select("id", F.col("col").alias("key"), (F.col("n") - F.col("s") + F.col("pos") + 1).alias("pos"))
    components, _ = similar_components(shared.select("id", "n", "s", "hashes", *BITS), postings, percent, scratch)
    return components.join(shared.select(F.col("id").alias("node"), "lead", "tail"), "node")


def _runs(held: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers the runs of places [w0, w1) that overlap or touch."""
    in_doc = Window.partitionBy(*within).orderBy(*order)
    before = F.max("w1").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("new", F.when(before.isNull() | (F.col("w0") > before), 1).otherwise(0))
    return held.withColumn(name, F.sum("new").over(in_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("new")


def _ends(known: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, stretch, side, more, to): by how many words a stretch grows to a side, and to which code point it reaches.

    The kept copy is the place of the cluster's least document, of the same content if it has it; that document
    itself grows along the largest one. A verbatim copy reaches less than SPREAD words beyond its pieces.
    """
    place = F.struct("doc_id", "w0", "w1")
    same = held.groupBy("content", "cluster_id", "first").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    same = scratch.table(same, "same")
    like = same.groupBy("cluster_id").agg(F.min("low").alias("low_like"), F.max("high").alias("high_like"))
    ends = held.groupBy("doc_id", "stretch").agg(F.min(F.struct(F.col("w0").alias("at"), "content")).alias("left"), F.max(F.struct(F.col("w1").alias("at"), "content")).alias("right"))
    both = F.array(*[F.struct(F.lit(s).alias("side"), f"{c}.at", f"{c}.content") for s, c in enumerate(("left", "right"))])
    ends = ends.select("doc_id", "stretch", F.explode(both).alias("e")).select("doc_id", "stretch", "e.*").join(same, "content").join(like, "cluster_id")
    kept = F.when(F.col("low.doc_id") == F.col("first"), F.col("low")).otherwise(F.col("low_like"))
    other = F.when(F.col("high.doc_id") != F.col("first"), F.col("high")).otherwise(F.col("high_like"))
    ends = ends.withColumn("by", F.when(F.col("doc_id") == F.col("first"), other).otherwise(kept))
    ends = ends.select("doc_id", "stretch", "side", "at", F.col("by.doc_id").alias("by"), F.when(F.col("side") == 0, F.col("by.w0")).otherwise(F.col("by.w1")).alias("by_at"))
    ends = scratch.table(ends, "ends")
    wanted = ends.select("doc_id", "at", "side").union(ends.select("by", "by_at", "side")).distinct()
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("at", "side")).alias("wanted"))
    found = known.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(frugal(_contexts), CONTEXTS)
    found = scratch.table(found, "contexts")
    theirs = found.groupBy(F.col("doc_id").alias("by"), F.col("at").alias("by_at"), "side").agg(F.max("words").alias("theirs"))
    grown = ends.join(found, ["doc_id", "at", "side"]).join(theirs, ["by", "by_at", "side"])
    differs = F.array_position(F.zip_with("words", "theirs", lambda a, b: ~a.eqNullSafe(b)), True)
    grown = grown.withColumn("more", F.when(differs > 0, differs - 1).otherwise(F.size("words")).cast("int"))
    reach = F.struct("more", F.when(F.col("more") > 0, F.get("points", F.col("more") - 1)).otherwise(F.col("here")).alias("to"))
    return grown.groupBy("doc_id", "stretch", "side").agg(F.max(reach).alias("m")).select("doc_id", "stretch", "side", "m.more", "m.to")


def repeated_passages(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, end (code points), n_paragraphs, cluster_id, removed: the passages of each document that repeat
    in another one. A passage is all pieces and paragraphs of a document that overlap or touch, and the words beside
    them that agree with the kept copy; it has `least_words` words or more, or is all of its text.

    Equal pieces or paragraphs are one content, however lines end. Contents of paragraphs that share a MinHash band
    with another are compared by exact Jaccard similarity, and components of them are clusters. In each cluster what
    the least doc_id has stays; a passage is `removed` if it has a part that doesn't.

    A null or empty text has no words. Rows without an id are documents that repeat nothing by themselves; rows of
    one id are one document, in which places of the rows' texts count alike. An empty table gives an empty result;
    other columns are ignored; the order and dealing out of rows don't matter.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text is not null")
    bands = bands_for(percent=percent)
    places = scratch.table(known.mapInArrow(frugal(lambda b: _places(b, bands)), _place_schema(bands)), "places")
    low = places.groupBy("content").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("k0").alias("lines"), F.count(F.lit(1)).alias("n"))
    low = scratch.table(low.filter("low < high or lines > 0"), "low")
    components = _near_components(places, known, low, bands, percent, scratch)

    contents = low.join(components.withColumnRenamed("node", "content"), "content", "left").filter("low < high or component is not null")
    # a paragraph that stands in one document alone is told without the words at its ends that no other has
    alone = F.col("component").isNotNull() & ~F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    contents = contents.withColumns({"component": F.coalesce("component", "content"), "lead": F.when(alone, F.col("lead")), "tail": F.when(alone, F.col("tail"))})
    clusters = contents.groupBy("component").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last")
    repeated = scratch.table(contents.join(clusters, "component").select("content", F.col("component").alias("cluster_id"), "first", "lead", "tail", "n"), "repeated")
    hot = F.broadcast(repeated.filter(F.col("n") * HOT >= places.count()).drop("n"))
    seats = places.select("content", "doc_id", "w0", "w1", "words").filter("doc_id is not null")
    held = seats.join(hot, "content").unionByName(seats.join(hot, "content", "left_anti").join(repeated.drop("n"), "content"))
    held = held.withColumns({"w0": F.col("w0") + F.coalesce("lead", F.lit(0)), "w1": F.coalesce(F.col("w0") + F.col("tail"), "w1")}).drop("lead", "tail").distinct()
    held = scratch.table(_runs(held, ["doc_id"], ["w0", "w1", "content"], "stretch"), "held")
    found = held.groupBy("doc_id", "stretch").agg(
        F.min("w0").alias("w0"),
        F.max("w1").alias("w1"),
        F.max("words").alias("words"),
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.min("cluster_id").alias("cluster_id"),
        F.max(F.col("doc_id") != F.col("first")).alias("removed"),
    )
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    ends = _ends(known, held, scratch).groupBy("doc_id", "stretch").agg(of(0, "more").alias("before"), of(1, "more").alias("behind"), of(0, "to").alias("start"), of(1, "to").alias("end"))
    found = found.join(ends, ["doc_id", "stretch"]).withColumns({"w0": F.col("w0") - F.col("before"), "w1": F.col("w1") + F.col("behind")})
    # what is grown may meet the next stretch; what is kept is not joined to what is removed
    found = _runs(found, ["doc_id", "removed"], ["w0", "w1"], "run").groupBy("doc_id", "removed", "run").agg(
        F.min("start").cast("long").alias("start"),
        F.max("end").cast("long").alias("end"),
        (F.max("w1") - F.min("w0")).alias("length"),
        F.max("words").alias("words"),
        F.sum("n_paragraphs").alias("n_paragraphs"),
        F.min("cluster_id").alias("cluster_id"),
    )
    return found.filter((F.col("length") >= least_words) | (F.col("length") >= F.col("words"))).select("doc_id", "start", "end", "n_paragraphs", "cluster_id", "removed")
