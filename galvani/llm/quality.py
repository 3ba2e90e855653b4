"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, with a softmax output."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .hashing import SPACE, SpanHashes, word_spans

#: Buckets of hashed words and n-grams (16 bits), and the length of their vectors.
BUCKETS, WIDTH = 65_536, 16
#: Bytes of the character n-grams.
GRAMS = (2, 3, 4)
#: About so many labelled documents are learned from, in so many passes, from these rates (of the output weights, and of
#: the vectors, of which each has a small part in a document's mean) down to none.
SAMPLE, PASSES, RATE, VECTOR_RATE = 4000, 8, 0.8, 20.0
#: From this score on a document is predicted to be of quality.
LEAST_SCORE = 0.7


def buckets(text: str | None) -> np.ndarray:
    """Buckets of every word, and of every n-gram of bytes of the text with single blanks between words."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    start, end = word_spans(data, SPACE)
    if not len(start):
        return np.zeros(0, np.int64)
    flat = np.where(SPACE[data], np.uint8(32), data)
    keep = np.concatenate([[True], (flat[1:] != 32) | (flat[:-1] != 32)])
    words = SpanHashes(data)(start, end) >> np.uint64(48)
    flat = np.concatenate([[32], flat[keep], [32]]).astype(np.uint32)
    out = [words.astype(np.int64)]
    with np.errstate(over="ignore"):
        rolled = flat * np.uint32(0x01000193)
        for n in range(2, max(GRAMS) + 1):
            rolled = (rolled[:-1] ^ flat[n - 1 :]) * np.uint32(0x01000193)
            if n in GRAMS:
                out.append((((rolled ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64))
    return np.concatenate(out)


def _features(batches):
    for batch in batches:
        rows = []
        for label, text in zip(batch.column("quality").to_pylist(), batch.column("text"), strict=True):
            at, n = np.unique(buckets(text.as_py()), return_counts=True)
            rows.append((label, at.astype(np.uint16).tobytes(), n.astype(np.uint32).tobytes()))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["quality", "at", "n"])


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    """Stochastic gradient descent, a document at a time, over vectors and output weights. What it gives back is each
    bucket's share in the difference of the two outputs, as the mean of vectors times weights is the mean of these."""
    docs = [(int(q), np.frombuffer(a, np.uint16), np.frombuffer(n, np.uint32)) for q, a, n in zip(rows["quality"], rows["at"], rows["n"], strict=True)]
    docs = [d for d in docs if len(d[1])]
    docs.sort(key=lambda d: (d[0], d[1].tobytes(), d[2].tobytes()))  # whatever order the shuffle gave
    random = np.random.default_rng(7)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    weights = np.zeros((2, WIDTH), np.float32)
    share = {q: max(1, sum(d[0] == q for d in docs)) for q in (0, 1)}
    steps, done = PASSES * len(docs), 0
    for _ in range(PASSES):
        for k in random.permutation(len(docs)):
            label, at, n = docs[k]
            part = (n / n.sum()).astype(np.float32)
            mean = part @ vectors[at]
            out = weights @ mean
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1
            # both labels weigh the same as a whole
            rate = (1 - done / steps) * min(4.0, 0.5 * len(docs) / share[label])
            back = p @ weights
            weights -= RATE * rate * np.outer(p, mean).astype(np.float32)
            vectors[at] -= np.outer(part, VECTOR_RATE * rate * back).astype(np.float32)
            done += 1
    return pd.DataFrame({"weights": [(vectors @ (weights[1] - weights[0])).astype(np.float32).tobytes()]})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Learn from about `sample` labelled documents, chosen by a hash of their ids; held-out ids are never among them.

    Labels other than 0 and 1 are left out, as are ids with both. The sampled labels (bounded by `sample`) are
    broadcast to the documents; one task trains. None where nothing can be learned from.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
    known = known.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = known.count()
    unit_hash = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = known.filter(unit_hash < sample / max(1, n)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # rows of one id are one document
    features = texts.select("quality", "text").mapInArrow(_features, "quality int, at binary, n binary")
    found = features.groupBy(F.lit(0).alias("one")).applyInPandas(_train, "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else None


def score_text(text: str | None, weights: np.ndarray | None) -> float:
    at = buckets(text)
    if weights is None or not len(at):
        return 0.5
    return float(1 / (1 + np.exp(-np.clip(weights[at].mean(dtype=np.float64), -500, 500))))


def score_quality(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id and score of each document: how likely label 1 is. One pass without a shuffle.

    Null and empty texts, and all texts where there was nothing to learn from, score 0.5. A null id is kept; repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score_text(t.as_py(), weights) for t in batch.column("text")], pa.float64())], ["doc_id", "score"])

    known = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return known.mapInArrow(run, "doc_id long, score double")


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op4 columns. Repeated rows of an id are learned from once, by their least text, and scored each for itself; a
    null id is never learned from, and not held out."""
    return score_quality(docs, learn(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
