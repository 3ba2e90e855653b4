"""N-gram Jaccard join: the global n-gram order is cut into fragments, overlaps are counted in each and summed for each pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, give_back, lots
from .hashing import SPACE, SpanHashes, mix, word_spans
from .setjoin import BITS, similar_components

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 75
#: So many of a lot's most frequent shingles are counted over all lots; a shingle that has one in HOT of all entries
#: or more is hot: it comes last in the global order and is never gathered in one task.
HOT = 4096
#: Entries of a fragment of the global order, about.
FRAGMENT_ENTRIES = 2_000_000
#: Characters of the texts of which sets are held at once.
LOT_CHARS = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

MEMBERS = "doc_id long, n int, k1 long, k2 long, shingle long, seen long"
PACKED = "fragment int, k1 binary, k2 binary, n binary, held binary, shingles binary"
SHARED = "bucket int, k1 binary, k2 binary, n binary, held binary, shingles binary, seen binary"
SETS = "k1 long, k2 long, n int, s int, prefix int, hashes array<long>, " + ", ".join(f"{c} long" for c in BITS)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: each a span of lower-cased words with single blanks between.
    Two different shingles of a table of 10^10 have one hash with a probability of about 10^-9 a pair."""
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    start, end = word_spans(data, SPACE)
    if not len(start):
        return np.zeros(0, np.uint64)
    # words with one blank behind each
    keep = np.ones(len(data), bool)
    blank = SPACE[data]
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[: start[0]] = False
    flat = np.where(blank, np.uint8(32), data)[keep]
    length = end - start
    first = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    last = first + length
    k = min(words, len(first))
    return np.unique(SpanHashes(flat)(first[: len(first) - k + 1], last[k - 1 :]))


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix(shingles + np.uint64(1))) ^ np.uint64(len(shingles))
        b = np.add.reduce(mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _members(batches):
    for batch in lots(batches, LOT_CHARS, 10_000):
        rows, lot = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            s = shingle_set(text.as_py())
            rows.append((doc_id, len(s), *(set_key(s) if len(s) else (None, None)), None, None))
            lot.append(s)
        shingles, seen = np.unique(np.concatenate(lot), return_counts=True) if lot else (np.zeros(0, np.uint64), np.zeros(0, int))
        top = np.argsort(-seen, kind="stable")[:HOT]
        rows += [(None, None, None, None, int(s), int(c)) for s, c in zip(shingles[top].astype(np.int64), seen[top], strict=True) if c > 1]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], names)


def _distinct_sets(batches):
    """The sets of a task's documents, each set once, in lots of bounded size."""
    seen, found, size = set(), [], 0
    for batch in batches:
        for text in batch.column("text"):
            text = text.as_py()
            s = shingle_set(text)
            if len(s) and (key := set_key(s)) not in seen:
                seen.add(key)
                found.append((key, s))
                size += len(text)
            if size >= LOT_CHARS:
                yield found
                found, size = [], 0
    yield found


def _pack(batches, fragments: int, hot: np.ndarray):
    """A lot's shingles without the hot ones, a row for each fragment with all its sets."""
    for found in _distinct_sets(batches):
        if not found:
            continue
        sets = [s[~np.isin(s, hot, assume_unique=True)] if len(hot) else s for _, s in found]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        shingles = np.concatenate(sets)
        # ranges of equal width: the fragment grows with the hash
        part = ((shingles >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((owner, part))
        owner, shingles, part = owner[order], shingles[order], part[order]
        k1, k2 = (np.array([k[i] for k, _ in found], np.int64) for i in (0, 1))
        n = np.array([len(s) for _, s in found], np.int32)
        edges = np.searchsorted(part, np.arange(fragments + 1))
        rows = []
        for f in np.flatnonzero(edges[1:] > edges[:-1]):
            lo, hi = edges[f], edges[f + 1]
            own, held = np.unique(owner[lo:hi], return_counts=True)
            rows.append((int(f), k1[own].tobytes(), k2[own].tobytes(), n[own].tobytes(), held.astype(np.uint32).tobytes(), shingles[lo:hi].tobytes()))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], [c.split()[0] for c in PACKED.split(", ")])


def _by_bucket(k1, k2, n, owner, shingles, seen, buckets: int) -> pa.Table:
    """Rows of SHARED: entries (owner numbers the sets, in order) by bucket of the set's key, a row for each bucket."""
    bucket = ((k1.astype(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket[owner], kind="stable")
    owner, shingles, seen = owner[order], shingles[order], seen[order]
    edges = np.searchsorted(bucket[owner], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(edges[1:] > edges[:-1]):
        lo, hi = edges[b], edges[b + 1]
        own, held = np.unique(owner[lo:hi], return_counts=True)
        rows.append((int(b), *(x[own].tobytes() for x in (k1, k2, n)), held.astype(np.uint32).tobytes(), shingles[lo:hi].tobytes(), seen[lo:hi].astype(np.int32).tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=[c.split()[0] for c in SHARED.split(", ")])


def _read(table: pa.Table, **kinds) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in kinds.items()]


def _numbered(k1, k2, n):
    """A number for each row's set, in the order of keys, and each set's keys and size: a set may come in several rows."""
    order = np.lexsort((k2, k1))
    new = np.concatenate([[True], (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)])
    number = np.empty(len(k1), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, *(x[order][new] for x in (k1, k2, n))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _fragment(table: pa.Table, buckets: int) -> pa.Table:
    """One fragment: in how many sets each shingle is, and the entries of those that are in two or more."""
    k1, k2, n, held, shingles = _read(table, k1=np.int64, k2=np.int64, n=np.int32, held=np.uint32, shingles=np.uint64)
    number, k1, k2, n = _numbered(k1, k2, n)
    owner = np.repeat(number, held)
    order = np.lexsort((owner, shingles))
    owner, shingles = owner[order], shingles[order]
    keep = _changes(owner, shingles)
    owner, shingles = owner[keep], shingles[keep]
    starts = np.append(np.flatnonzero(_changes(shingles)), len(shingles))
    seen = np.repeat(np.diff(starts), np.diff(starts))
    owner, shingles, seen = owner[seen > 1], shingles[seen > 1], seen[seen > 1]
    order = np.argsort(owner, kind="stable")
    return _by_bucket(k1, k2, n, owner[order], shingles[order], seen[order], buckets)


def _hot_entries(batches, hot: np.ndarray, buckets: int):
    """The hot shingles of a lot's sets, straight to the sets' buckets: they come last in the order, whatever their count."""
    for found in _distinct_sets(batches):
        mine = [(key, len(s), h) for key, s in found if len(h := s[np.isin(s, hot, assume_unique=True)])]
        if mine:
            k1, k2 = (np.array([k[i] for k, _, _ in mine], np.int64) for i in (0, 1))
            owner = np.repeat(np.arange(len(mine)), [len(h) for _, _, h in mine])
            shingles = np.concatenate([h for _, _, h in mine])
            yield from _by_bucket(k1, k2, np.array([n for _, n, _ in mine], np.int32), owner, shingles, np.full(len(owner), 2**31 - 1), buckets).to_batches()


def _in_order(table: pa.Table, percent: int) -> pa.Table:
    """One bucket of sets: the shared shingles of each in the global order, rare ones first, and how many of them its
    prefix holds.

    Sets of Jaccard similarity t have a shingle in common within their first n - ceil(t n) + 1 in any one order. What
    only one set has comes first; a set of which that fills the prefix has no partner and goes.
    """
    k1, k2, n, held, shingles, seen = _read(table, k1=np.int64, k2=np.int64, n=np.int32, held=np.uint32, shingles=np.uint64, seen=np.int32)
    number, k1, k2, n = _numbered(k1, k2, n)
    owner = np.repeat(number, held)
    order = np.lexsort((shingles, seen, owner))
    owner, shingles = owner[order], shingles[order]
    keep = _changes(owner, shingles)  # hot entries may come from several tasks
    owner, shingles = owner[keep], shingles[keep]
    s = np.bincount(owner, minlength=len(n))
    prefix = n - -(-percent * n // 100) + 1 - (n - s)
    keep = prefix > 0
    at = np.concatenate([[0], np.cumsum(s[keep])]).astype(np.int32)
    kept = shingles[keep[owner]]
    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(kept.astype(np.int64)))
    turn, word = np.uint64(1) << (kept & np.uint64(63)), (kept >> np.uint64(6)) & np.uint64(3)
    # each kept set has an entry: the first in its prefix
    bits = [pa.array(np.bitwise_xor.reduceat(np.where(word == k, turn, np.uint64(0)), at[:-1]).astype(np.int64) if len(at) > 1 else np.zeros(0, np.int64)) for k in range(len(BITS))]
    return pa.table([pa.array(k1[keep]), pa.array(k2[keep]), pa.array(n[keep], pa.int32()), pa.array(s[keep], pa.int32()), pa.array(prefix[keep], pa.int32()), lists, *bits], names=[c.split()[0] for c in SETS.split(", ")])


def join_by_ngrams(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to) of each document.

    1. Each document's set gets a key of 128 bits; documents of equal sets are one class from here on.
    2. The sets are cut along the global n-gram order into fragments; a fragment's task counts in how many sets each
       shingle is and drops what is in one only.
    3. By class, shingles are put in the global order; sets whose prefixes share a shingle are candidates.
    4. Overlaps of candidates are counted fragment by fragment and summed for each pair; links become components.

    A null or empty text, or one without words, has no shingles and is linked with nothing; fewer words than a
    shingle has are one shingle. A null doc_id is the least of nothing: it takes its component from others or is
    null. Rows of one id are documents of their own. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    table = scratch.table(known.mapInArrow(frugal(_members), MEMBERS), "members")
    members = table.filter("n is not null").select("doc_id", "n", "k1", "k2")
    entries = members.agg(F.sum("n")).first()[0] or 0
    frequent = table.filter("n is null").groupBy("shingle").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= max(2, entries // HOT))
    hot = np.sort(np.array([r["shingle"] for r in frequent.collect()], np.int64).astype(np.uint64))  # HOT at most
    fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // FRAGMENT_ENTRIES))

    shared = known.select("text").mapInArrow(frugal(lambda b: _pack(b, fragments, hot)), PACKED).groupBy("fragment").applyInArrow(lambda t: give_back(_fragment(t, fragments)), SHARED)
    if len(hot):
        shared = shared.unionByName(known.select("text").mapInArrow(frugal(lambda b: _hot_entries(b, hot, fragments)), SHARED))
    sets = shared.groupBy("bucket").applyInArrow(lambda t: give_back(_in_order(t, percent)), SETS)
    sets = scratch.table(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    postings = sets.select("id", "n", "s", F.posexplode(F.slice("hashes", 1, F.col("prefix")))).select("id", F.col("col").alias("key"), (F.col("n") - F.col("s") + F.col("pos") + 1).alias("pos"))
    components, _ = similar_components(sets.select("id", "n", "s", "hashes", *BITS), postings, percent, scratch)

    classes = members.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    placed = classes.join(sets.select("k1", "k2", "id"), ["k1", "k2"], "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    placed = scratch.table(placed.select("k1", "k2", "least", "component"), "classes")
    label = placed.filter("component is not null").groupBy("component").agg(F.min("least").alias("label"))
    placed = placed.join(label, "component", "left").select("k1", "k2", F.coalesce("label", "least").alias("label"))
    # classes are unique on the right; a class with very many documents is a skewed partition on the left, which Spark splits
    return members.join(placed, ["k1", "k2"], "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, that have the least doc_id of their component.

    Of rows that repeat both id and text one stays. Rows without an id can't be told apart by it: where one of them is
    in a component without any id, all stay, one of each text.
    """
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = join_by_ngrams(docs, percent).filter(same).groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("again")).select(F.col("doc_id").alias("kept_id"), "again")
    # names of the documents' columns can't clash with these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("row_id"))
    rows = rows.join(kept, F.col("row_id").eqNullSafe(F.col("kept_id")))
    once = rows.filter("not again").select("row.*")
    return once.unionByName(rows.filter("again").select("row.*").dropDuplicates(["doc_id", "text"]))
