"""Document fingerprints by winnowing, in DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

#: Code points of a token at most: tokens are runs without white space, cut into pieces of so many.
PIECE = 8
#: Tokens of a k-gram, and k-grams of a window: a run of K + WINDOW - 1 equal tokens is sure to share a fingerprint.
K, WINDOW = 3, 4
#: The rolling hash: a polynomial of the tokens' hashes below the prime MODULUS.
BASE, MODULUS = 1_000_003, 2_147_483_647
LAST = 4_294_967_295


def with_fingerprints(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """The rows with a column of packed fingerprints of a text column without nulls.

    Steps are columns of their own, as a lambda would evaluate an expression of an array anew for each element.
    """
    t, h, n, g = (f"{out}_{c}" for c in ("tokens", "hashes", "n", "mins"))
    step = lambda a, x: (a * BASE + x) % MODULUS
    df = df.withColumn(t, F.regexp_extract_all(F.col(text), F.lit(rf"([^\x20\x09-\x0D]{{1,{piece}}})"), F.lit(1)))
    # a token's hash: the first 32 bits of its MD5, below the modulus
    df = df.withColumn(h, F.transform(t, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long") % MODULUS)).drop(t)
    df = df.withColumn(n, F.size(h))
    rolled = F.transform(F.sequence(F.lit(0), F.col(n) - k), lambda i: reduce(step, [F.get(F.col(h), i + j) for j in range(1, k)], F.get(F.col(h), i)))
    short = F.array(F.aggregate(h, F.lit(0).cast("long"), step))
    grams = F.when(F.col(n) == 0, F.array().cast("array<long>")).when(F.col(n) < k, short).otherwise(rolled)
    # hash * 2^32 + (2^32 - 1 - place): the least of a window is its smallest hash, and of equal ones the rightmost
    df = df.withColumn(g, F.transform(grams, lambda x, i: F.shiftleft(x, 32) + (LAST - i.cast("long")))).drop(h)
    span = 1
    while span < window:  # minima over 2, 4 and 8 places
        shift = min(span, window - span)
        df, span = _min_with_later(df, g, n, shift), span + shift
    return df.withColumn(out, F.array_distinct(g)).drop(g, n)


def _min_with_later(df: DataFrame, g: str, n: str, shift: int) -> DataFrame:
    """The least of each value and that `shift` places later; where there are no more than `shift`, the least of all."""
    df = df.withColumn(n, F.size(g))
    left = F.col(n) - shift
    pair = F.zip_with(F.slice(g, 1, left), F.slice(g, shift + 1, left), lambda a, b: F.least(a, b))
    return df.withColumn(g, F.when(left > 0, pair).when(F.col(n) > 0, F.array(F.array_min(g))).otherwise(F.col(g)))


def hash_of(packed: Column) -> Column:
    return F.shiftright(packed, 32)


def place_of(packed: Column) -> Column:
    return LAST - packed.bitwiseAND(F.lit(LAST))


def hash_set(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / union.cast("double"))


def as_text(packed: Column) -> Column:
    """hash:place of each fingerprint, in the order of places."""
    return F.array_join(F.transform(packed, lambda p: F.concat_ws(":", hash_of(p).cast("string"), place_of(p).cast("string"))), ",")


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its fingerprints: (hash, place of the k-gram's first token). No shuffle.

    A null or empty text, or one of white space alone, has none; a text of fewer than k tokens has one; a null id is
    kept; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    known = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return with_fingerprints(known, "text", "prints", k, window).select(
        "doc_id", F.transform("prints", lambda p: F.struct(hash_of(p).alias("hash"), place_of(p).alias("place"))).alias("fingerprints")
    )


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at most the key: found among every step-th cut first, then among those between."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    held = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    coarse = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]).cast("array<long>") if len(cuts) >= step else F.array().cast("array<long>")
    upto = lambda cs: F.size(F.filter(cs, lambda c: c <= key))
    return upto(coarse) * step + upto(F.slice(held, upto(coarse) * step + 1, step))


def with_next(rows: DataFrame, carried: list[str], ranges: int | None = None) -> DataFrame:
    """The rows (doc_id, text and more), and next_<c> for each carried column: its value in the next row by ascending
    doc_id, and after the last row in the first. Null ids come first; rows of one id go by their text.

    Ids are cut into as many ranges as there are shuffle partitions, at quantiles of a sketch of bounded size, which
    are ids of the table. Each range gets the first row of the following one as a further row at its end, so every
    range is sorted and read on its own, whatever the number of rows.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(2**63)
    steps = ",".join(f"{i / ranges:.9f}D" for i in range(1, max(2, ranges)))
    seen = rows.agg(F.expr(f"percentile_approx(doc_id, array({steps}), 10000)").alias("cuts"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    least = lowest if seen["nulls"] or seen["least"] is None else seen["least"]
    cuts = sorted({c for c in seen["cuts"] or [] if c > least})
    key = F.coalesce("doc_id", F.lit(lowest))
    rows = rows.withColumn("key", key).withColumn("range", _range_of(F.col("key"), cuts)).withColumn("ghost", F.lit(False))
    heads = rows.filter(F.col("key").isin([least, *cuts]))
    one = heads.groupBy("key", "range").agg(F.min(F.struct("text", *[F.col(c) for c in carried if c != "text"])).alias("head"))
    same = {c: F.col(f"head.{c}") for c in {"text", *carried}}
    ghosts = one.select(
        *[same.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema if f.name not in ("key", "range", "ghost")],
        "key",
        F.pmod(F.col("range") - 1, F.lit(len(cuts) + 1)).cast("int").alias("range"),
        F.lit(True).alias("ghost"),
    )
    in_order = Window.partitionBy("range").orderBy("ghost", "key", "text")
    both = rows.withColumn("range", F.col("range").cast("int")).unionByName(ghosts)
    return both.withColumns({f"next_{c}": F.lead(c).over(in_order) for c in carried}).filter(~F.col("ghost")).drop("key", "range", "ghost")


def near_copies(docs: DataFrame) -> DataFrame:
    """The op8 columns: fingerprints of each text and of its edited text, and how alike those are and the next document's.

    A text is fingerprinted before the rows are put in order, so that its neighbour needn't do it again.
    """
    known = id_and_text(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_next(with_fingerprints(known, "text", "own"), ["text", "own"])
    cut = "cast(floor(char_length(text) / 4) as int)"
    edited = F.expr(f"concat(left(text, char_length(text) - {cut}), left(next_text, {cut}))")
    found = found.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    found = with_fingerprints(found, "edited", "other")
    found = found.withColumns({c: hash_set(F.col(p)) for c, p in (("a", "own"), ("b", "other"), ("c", "next_own"))})
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
