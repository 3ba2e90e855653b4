"""Components of sets of which some share a posting key, by exact Jaccard similarity, without all pairs of a group.

A posting key (a shingle, a band of a signature) may hold a third of all sets. Rounds of stars link most of a group:
each set is compared with that leader of its keys which is most like it. Only sets of one key that are still in
different components are compared with each other afterwards, so that no link between components is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galvani.operators.components import connected_components

from .common import Scratch

#: Fragments into which the global order of the hashes is cut; the first prunes pairs for the others.
FRAGMENTS = 4
#: Rounds of stars before the sets of different components are compared, and leaders of a key in each but the first.
ROUNDS, LEADERS = 2, 4


def alike(overlap: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether so large an intersection makes the Jaccard similarity reach the percentage, in whole numbers."""
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def fragments(sets: DataFrame, count: int = FRAGMENTS) -> DataFrame:
    """id, fragment, part: each set's hashes by ranges of the global order of hashes."""
    bits = (count - 1).bit_length()
    assert 1 << bits == count
    cut = F.array(*[F.struct(F.lit(f).alias("fragment"), F.filter("hashes", lambda h: F.shiftrightunsigned(h, 64 - bits) == f).alias("part")) for f in range(count)])  # noqa: B023
    return sets.select("id", F.explode(cut).alias("cut")).select("id", "cut.*").filter(F.size("part") > 0)


def _partial(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Partial overlaps of pairs, by fragment."""
    a = parts.select(F.col("id").alias("a"), "fragment", F.col("part").alias("part_a"))
    b = parts.select(F.col("id").alias("b"), "fragment", F.col("part").alias("part_b"))
    found = pairs.join(a, ["a", "fragment"]).join(b, ["b", "fragment"])
    return found.select("a", "b", F.size(F.array_intersect("part_a", "part_b")).alias("partial"), F.size("part_a").alias("of_a"), F.size("part_b").alias("of_b"))


def linked(pairs: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b, n_a, n_b, s_a, s_b) whose Jaccard similarity reaches the percentage.

    n is the size of a set, s that of its stored part (what no other set has is not stored). Overlaps are counted
    fragment by fragment and summed for each pair. After the first fragment a pair goes on only if it could still
    reach the threshold if all that is left were shared.
    """
    first = pairs.select("*", F.lit(0).alias("fragment")).join(
        parts.select(F.col("id").alias("a"), "fragment", F.col("part").alias("part_a")), ["a", "fragment"], "left"
    ).join(parts.select(F.col("id").alias("b"), "fragment", F.col("part").alias("part_b")), ["b", "fragment"], "left")
    none = F.array().cast("array<long>")
    first = first.withColumns({c: F.coalesce(c, none) for c in ("part_a", "part_b")})
    best = F.col("partial") + F.least(F.col("s_a") - F.size("part_a"), F.col("s_b") - F.size("part_b"))
    first = first.withColumn("partial", F.size(F.array_intersect("part_a", "part_b"))).filter(alike(best, F.col("n_a"), F.col("n_b"), percent))
    first = scratch.table(first.select("a", "b", "n_a", "n_b", "partial"), "first")
    later = first.select("a", "b", F.explode(F.array(*[F.lit(f) for f in range(1, FRAGMENTS)])).alias("fragment"))
    counts = first.select("a", "b", "partial").unionByName(_partial(later, parts).select("a", "b", "partial"))
    sums = counts.groupBy("a", "b").agg(F.sum("partial").alias("overlap"))
    found = first.select("a", "b", "n_a", "n_b").join(sums, ["a", "b"]).filter(alike(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent))
    return scratch.table(found.select("a", "b"), "links")


def may_reach(a: str, b: str, percent: int) -> Column:
    """Whether sets that first agree at these places of the global order can still reach the threshold: no more than
    what follows there in the shorter rest can be shared (the positional filter)."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    return alike(1 + F.least(n_a - F.col(f"{a}pos"), n_b - F.col(f"{b}pos")), n_a, n_b, percent)


#: Columns of 64 bits each in which every stored hash of a set turns one bit over.
BITS = ("x0", "x1", "x2", "x3")


def bits_of(hash_: str) -> list[Column]:
    """Aggregates that give BITS from a row for each stored hash of a set."""
    turn = f"shiftleft(1L, cast({hash_} & 63 as int))"
    return [F.expr(f"bit_xor(CASE WHEN ({hash_} >> 6) & 3 = {k} THEN {turn} ELSE 0L END)").alias(c) for k, c in enumerate(BITS)]


def may_be_alike(a: str, b: str, percent: int) -> Column:
    """Whether two sets may reach the threshold by what they are known to differ in: each bit in which BITS differ is a
    hash that only one of them has, as is each that isn't stored. So variants of one text are told apart without
    their hashes, and pairs of a large family that are unlike go no further."""
    return (100 + percent) * differences(a, b) <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


def differences(a: str, b: str) -> Column:
    """How many hashes only one of two sets is known to have."""
    col = lambda side, c: F.col(f"{side}{c}")
    return sum((F.bit_count(col(a, c).bitwiseXOR(col(b, c))) for c in BITS), (col(a, "n") - col(a, "s")) + (col(b, "n") - col(b, "s")))


def similar_components(sets: DataFrame, postings: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the sets with a link, and the links (a, b) that were found.

    sets: id, n, s, hashes (distinct), BITS. postings: key, id, pos; sets that may be alike share a key, and of the first key
    that two sets share, pos is its place in the global order of either set's hashes (1 where there is no order).
    Tables of the shared folder; both may be empty.
    """
    spark = sets.sparkSession
    parts = scratch.table(fragments(sets), "parts")
    held = scratch.table(postings.join(sets.select("id", "n", "s", *BITS), "id").select("key", "id", "pos", "n", "s", *BITS), "postings")
    links = scratch.table(spark.createDataFrame([], "a long, b long"), "links")
    components = None
    for turn in range(ROUNDS + 1):
        if components is None:
            at = held.withColumn("component", F.col("id"))
        else:
            at = held.join(components.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        # the first leader is the set with the least that is its own; later ones are others for each key, so that a set
        # meets many, and those of sets that are alike in several keys are likely to be among them
        ranks = [F.col("n") - F.col("s")] if turn == 0 else [F.xxhash64("key", "id", F.lit(turn * LEADERS + k)) for k in range(LEADERS)]
        leaders = F.array(*[F.min(F.struct(rank.alias("rank"), "id", "component", "n", "s", "pos", *BITS)) for rank in ranks])
        mixed = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), leaders.alias("leaders"))
        mixed = mixed.filter("low < high").select("key", F.transform("leaders", lambda x: x.dropFields("rank")).alias("leaders"))
        if turn < ROUNDS:
            star = at.join(mixed, "key").withColumn("leader", F.explode("leaders"))
            star = star.filter((F.col("component") != F.col("leader.component")) & may_reach("", "leader.", percent) & may_be_alike("", "leader.", percent))
            nearest = F.min(F.struct((differences("", "leader.") / (F.col("n") + F.col("leader.n"))).alias("share"), "leader"))
            best = star.groupBy("id", "n", "s").agg(nearest.alias("best")).select("id", "n", "s", "best.leader")
            pairs = best.select(F.col("id").alias("a"), F.col("leader.id").alias("b"), F.col("n").alias("n_a"), F.col("leader.n").alias("n_b"), F.col("s").alias("s_a"), F.col("leader.s").alias("s_b"))
        else:
            side = scratch.table(at.join(mixed.select("key"), "key"), "open")
            a, b = (side.select("key", F.struct("id", "pos", "n", "s", "component", *BITS).alias(x)) for x in "ab")
            cross = a.join(b, "key").filter((F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & may_reach("a.", "b.", percent) & may_be_alike("a.", "b.", percent))
            pairs = cross.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"), F.col("a.s").alias("s_a"), F.col("b.s").alias("s_b")).distinct()
        pairs = scratch.table(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = linked(pairs, parts, percent, scratch)
        if not found.isEmpty():
            links = scratch.table(links.unionByName(found).distinct(), "links")
            components = scratch.table(connected_components(links, lambda df: scratch.table(df, "round")), "components")
    if components is None:
        components = scratch.table(spark.createDataFrame([], "node long, component long"), "components")
    return components, links
