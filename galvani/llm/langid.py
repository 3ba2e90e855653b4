"""Language ID: nearest of several centroids per language, by cosine over normalised TF-IDF vectors of hashed n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, frugal, held_out, lots

#: Buckets of hashed n-grams.
BUCKETS = 8192
#: About so many labelled documents of each language are learned from.
SAMPLE = 500
#: Centroids of a language, and rounds of the clustering.
CENTROIDS, ROUNDS = 4, 10
#: A text is rejected where its cosine is below this share of what REJECT of the learned texts of that length fall below.
SHARE, REJECT = 0.6, 0.01
#: Texts of fewer n-grams are too short to be rejected by distance.
LEAST_GRAMS = 16
#: Lengths (powers of two) that have thresholds of their own.
LENGTHS = 24
#: Texts of which vectors are held at once, and about so many bytes of text.
CHUNK, LOT_BYTES = 64, 1_000_000
#: Share of the texts that each n-gram counts as being in besides.
SMOOTH = 0.05
UNKNOWN = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # rows of unit length
    idf: np.ndarray
    least: np.ndarray  # by centroid and the log2 of the count of n-grams


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its value if it is a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32)


#: A key: ASCII letters, _, - and at least a digit. It is looked for where a run starts only, so in linear time.
_KEY = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z_-]*+[0-9][A-Za-z0-9_-]*+")
#: Longer runs are text without blanks, not keys.
LONGEST_KEY = 64


def letter_codes(text: str) -> np.ndarray:
    """Code points in lower case; what isn't a letter is a blank, runs of blanks are one, with one at either end.
    Keys (numbers, hashes, ids) are left out, unless there is nothing else; all other letters are read."""
    plain = _KEY.sub(lambda m: " " if len(m[0]) <= LONGEST_KEY else m[0], text)
    codes = _codes(plain)
    return codes if len(codes) >= 3 or len(plain) == len(text) else _codes(text)


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[32], _letters()[codes], [32]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def gram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of one, two and three characters."""
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        a, b, c = (codes * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
        two = a[:-1] + (b[1:] ^ np.uint32(0x5BD1E995))
        grams = np.concatenate([a[1:-1], two, two[:-1] ^ (c[2:] + np.uint32(0x27D4EB2F))])
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (grams >> np.uint32(19)).astype(np.int64)


assert 1 << 13 == BUCKETS  # gram_buckets keeps 13 bits


def counts(text: str | None) -> np.ndarray | None:
    """Counts of n-grams by bucket; None for a text without letters."""
    codes = letter_codes(text) if text else ()
    return np.bincount(gram_buckets(codes), minlength=BUCKETS) if len(codes) >= 3 else None


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = tf.astype(np.float32)
    np.log1p(v, out=v)
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)
    return v


def spherical_means(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Clusters of unit vectors by cosine. Seeds: the vector nearest the mean, then each time the one farthest from all seeds."""
    picks = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    centers = x[picks]
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centers[j] for j in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centers


def _sample(docs: DataFrame, sample: int) -> DataFrame:
    """About `sample` texts of each language that may be learned from, chosen by a hash; fewer where there are fewer."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    share = known.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    unit_hash = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # one row for each language
    # a row that is repeated very often would otherwise come in as often
    return known.join(F.broadcast(share), "lang").filter(unit_hash < F.col("share")).select("lang", "text").distinct()


def _features(batches):
    for batch in lots(batches, LOT_BYTES):
        rows = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            codes = letter_codes(text)
            # beside each text excerpts of it, so that short texts have thresholds too; only the whole is clustered
            for n in (0, 16, 32, 64, 128, 256):
                part = codes if not n else codes[len(codes) // 3 :][: n + 2]
                if len(part) >= 3 and (not n or len(part) == n + 2):
                    tf = np.bincount(gram_buckets(part), minlength=BUCKETS)
                    at = np.flatnonzero(tf)
                    rows.append((lang, n == 0, at.astype(np.uint16).tobytes(), tf[at].astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "whole", "at", "tf"])


def _document_frequency(batches):
    seen, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for whole, at in zip(batch.column("whole").to_pylist(), batch.column("at"), strict=True):
            if whole:
                seen[np.frombuffer(at.as_py(), np.uint16)] += 1
                n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], seen]))], ["bucket", "n"])


def _length_class(grams) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(int), LENGTHS - 1)


def _vectors(rows: list[tuple[bytes, bytes]], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of so many rows."""
    tf = np.zeros((len(rows), BUCKETS), np.float32)
    for k, (at, n) in enumerate(rows):
        tf[k, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    return unit(tf, idf)


def _clusters(idf: np.ndarray, centroids: int):
    """Whole texts are clustered; excerpts, of which there are more, only give cosines, some rows at a time."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        whole = sorted(zip(rows["at"][rows["whole"]], rows["tf"][rows["whole"]], strict=True))  # whatever order the shuffle gave
        if not whole:
            return pd.DataFrame({"lang": [], "centroid": [], "least": []})
        centers = spherical_means(_vectors(whole, idf), centroids)
        held = list(zip(rows["at"], rows["tf"], strict=True))
        size = _length_class(np.array([np.frombuffer(n, np.uint32).sum() for _, n in held]))
        cos = np.concatenate([(_vectors(held[k : k + CHUNK], idf) @ centers.T).max(1) for k in range(0, len(held), CHUNK)])
        least = np.full(LENGTHS, np.inf)
        for b in np.unique(size):
            least[b] = np.quantile(cos[size == b], REJECT) * SHARE
        least = np.minimum.accumulate(least[::-1])[::-1]  # shorter texts are never held to more than longer ones
        least[np.isinf(least)] = least[np.isfinite(least)].max()
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centers], "least": [least.tobytes()] * len(centers)})

    return fit


def learn(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model | None:
    """Learn from about `sample` documents of each language: document frequencies over all of them, then a clustering
    for each language in a task of its own. The driver gets the frequencies and the centroids only. None where
    nothing can be learned from."""
    scratch = Scratch(docs.sparkSession)
    features = scratch.table(_sample(docs, sample).mapInArrow(frugal(_features), "lang string, whole boolean, at binary, tf binary"), "features")
    found = {r["bucket"]: r["n"] for r in features.mapInArrow(frugal(_document_frequency), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n, seen = max(1, found.get(-1, 0)), np.array([found.get(b, 0) for b in range(BUCKETS)])
    # smoothed, so that a few unseen n-grams (a name, a key) don't outweigh all that every text has
    idf = np.log(1 + n / (seen + SMOOTH * n)).astype(np.float32)
    rows = features.groupBy("lang").applyInPandas(_clusters(idf, centroids), "lang string, centroid binary, least binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    return Model([r["lang"] for r in rows], np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]), idf, np.stack([np.frombuffer(r["least"]) for r in rows]))


def _predict(texts: list[str | None], model: Model | None) -> list[tuple[str, float, bool]]:
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    for at in range(0, len(texts), CHUNK):
        known = [(k, c) for k in range(at, min(at + CHUNK, len(texts))) if (c := counts(texts[k])) is not None]
        if not known or model is None:
            continue
        tf = np.stack([c for _, c in known])
        cos = unit(tf, model.idf) @ model.centroids.T
        best, grams = np.argmax(cos, axis=1), tf.sum(1)
        top = np.clip(cos[np.arange(len(known)), best].astype(float), 0.0, 1.0)
        far = (top < model.least[best, _length_class(grams)]) & (grams >= LEAST_GRAMS)
        for (k, _), b, s, r in zip(known, best, top, far, strict=True):
            out[k] = model.langs[b], float(s), bool(r)
    return out


_LEARN = object()


def identify_languages(docs: DataFrame, model=_LEARN) -> DataFrame:
    """The rows with lang_pred, score (the cosine with the nearest centroid) and rejected. One pass without a shuffle.

    Text without a letter, and null text, is `und` and rejected, as is all text where there was nothing to learn
    from. A text farther from its nearest centroid than learned texts of that length is rejected, but keeps the
    language of that centroid; of equally near centroids the first by language is taken. A null doc_id is a document
    like any other, repeated rows give repeated results. A table without rows gives an empty result; columns of these
    names are replaced.
    """
    model = learn(docs) if model is _LEARN else model  # None: there was nothing to learn from
    kept = docs.drop("lang_pred", "score", "rejected")

    @frugal
    def run(batches):
        for batch in lots(batches, LOT_BYTES):
            found = _predict([t.as_py() for t in batch.column("text")], model)
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names, "lang_pred", "score", "rejected"]
            )

    added = T.StructType().add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return kept.mapInArrow(run, T.StructType(kept.schema.fields + added.fields))


def keep_known_languages(docs: DataFrame, model=_LEARN) -> DataFrame:
    """The rows, with all their columns, that identify_languages doesn't reject; one pass without a shuffle.

    Null and empty texts go; rows without an id and repeated rows stay as often as they come; a table without rows
    stays so; no column is added, so none can clash."""
    model = learn(docs) if model is _LEARN else model  # None: there was nothing to learn from

    @frugal
    def run(batches):
        for batch in lots(batches, LOT_BYTES):
            yield batch.filter(pa.array([not far for _, _, far in _predict([t.as_py() for t in batch.column("text")], model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """The op3 columns."""
    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return identify_languages(known, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
