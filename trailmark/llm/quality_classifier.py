"""Quality classifier: supervised subword embeddings.

A text is the bag of its words, of pairs of neighbouring words and of its character n-grams, hashed to ``BUCKETS``.
Each bucket has a learned vector; a text is their mean, and a softmax layer over it gives the class probabilities.
NumPy stochastic gradient descent fits both on the driver from at most ``max_labels`` labelled texts (those whose ids
hash lowest; the documented bound of the sample), which arrive as bucket counts.  As the class scores are linear in
the mean vector, scoring needs one number a bucket: every whole text is scored with array lookups, with a broadcast
of BUCKETS numbers.

Defined cases: null and empty texts have no features and get the learned prior; a text of any length is scored whole;
labels that are null or neither 0 nor 1 are not learned from, of repeated labels of one id the smaller counts; of
texts that share a labelled id the first in order is learned from; without labels of both classes the score of every
text is the share of label 1 seen (0.5 if none were); a score of exactly 0.5 is predicted as 1; repeated rows are
scored each; an empty table gives no rows; other columns pass through if asked for in ``keep``, whatever their
names, unless named like a column of the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _chunks as C

BUCKETS, DIMENSIONS = 1 << 16, 16
GRAMS = (3, 4)
#: Text bytes taken at once: a character has two n-grams with several numbers of eight bytes each.
SLICE = 1 << 19


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values over each [begin, end)."""
    out = np.zeros(len(begin))
    some = np.flatnonzero(end > begin)
    if len(some):
        edges = np.stack((begin[some], end[some]), axis=1).ravel()
        out[some] = np.add.reduceat(np.append(values, 0.0), edges)[::2]
    return out


def features(texts):
    """For each kind of feature: buckets, and where those of each text begin and end."""
    w = C.Words(texts)
    yield (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), w.first[:-1], w.first[1:]
    at, pair = w.ngrams(2)
    edge = np.searchsorted(at, w.first)
    yield (pair & np.uint64(BUCKETS - 1)).astype(np.int64), edge[:-1], edge[1:]
    # characters; a text begins at as many as bytes that begin one are before it
    x = np.frombuffer(w.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    offs = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))[w.offs]
    for n in GRAMS:
        if len(x) >= n:
            code = x[: len(x) - n + 1].astype(np.uint64)
            for k in range(1, n):
                code = code << np.uint64(21 - 5 * (n > 3)) ^ x[k : len(x) - n + 1 + k]
            code = C.mix(code + np.uint64(n))
            yield (code >> np.uint64(48)).astype(np.int64), offs[:-1], np.maximum(offs[:-1], offs[1:] - n + 1)


class Classifier:
    """Bucket scores (class 1 over class 0) and the bias; ``fit`` learns them."""

    def __init__(self, bucket: np.ndarray, bias: float):
        self.bucket, self.bias = bucket, bias

    @classmethod
    def fit(cls, rows: list, epochs: int = 12, rate: float = 4.0, seed: int = 7) -> Classifier:
        """rows: (label, buckets, counts) of each text."""
        rng = np.random.default_rng(seed)
        labels = [y for y, _, _ in rows]
        share = float(np.mean(labels)) if rows else 0.5
        if not 0 < share < 1:
            return cls(np.zeros(BUCKETS, np.float32), np.inf if share == 1 else -np.inf if share == 0 else 0.0)
        vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        weights, bias = np.zeros((2, DIMENSIONS), np.float32), np.log(np.array([1 - share, share], np.float32))
        step, steps = 0, epochs * len(rows)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                y, at, counts = rows[i]
                if len(at):
                    lr = rate * (1 - step / steps)
                    part = (counts / counts.sum(dtype=np.int64)).astype(np.float32)
                    mean = part @ vectors[at]
                    z = weights @ mean + bias
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    p[y] -= 1
                    back = p @ weights
                    weights -= lr * np.outer(p, mean)
                    bias -= 0.01 * lr * p
                    # the step of a bucket goes with the square root of its share, so that rare ones move as well
                    vectors[at] -= lr * np.outer(np.sqrt(part) * part.max() ** 0.5, back)
                step += 1
        return cls((vectors @ (weights[1] - weights[0])).astype(np.float32), float(bias[1] - bias[0]))

    def score(self, texts) -> np.ndarray:
        total, count = 0, 0
        for at, begin, end in features(texts):
            total = total + _sums(self.bucket[at].astype(np.float64), begin, end)
            count = count + (end - begin)
        z = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, learn_on: Column, id_col: str, text_col: str, label_col: str, max_labels: int) -> Classifier:
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_y"), learn_on.alias("_use"))
    known = known.filter("_use and _y in (0, 1)").withColumn("_y", F.col("_y").cast("int")).groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labels)

    def bags(batches):
        for batch in batches:
            for t in C.slices(batch, "_text", SLICE):
                found = list(features(t["_text"]))
                for d, y in enumerate(t["_y"].to_pylist()):
                    at, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[b[d] : e[d]] for x, b, e in found)]), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"y": pa.array([y], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "n": [np.minimum(n, 65535).astype(np.uint16).tobytes()]})

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    # max_labels rows of two numbers: small enough to broadcast at any corpus size
    rows = texts.join(F.broadcast(known), "_id").groupBy("_id").agg(F.min("_y").alias("_y"), F.min("_text").alias("_text")).select("_y", "_text").mapInArrow(bags, "y int, at binary, n binary").toArrow()
    rows = sorted(zip(*(rows[c].to_pylist() for c in ("y", "at", "n")), strict=True))
    found = Classifier.fit([(y, np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint16)) for y, at, n in rows])
    del rows
    C.trim()
    return found


def quality_score(docs: DataFrame, labels: DataFrame, learn_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = 3000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, held_out, score (probability of label 1), predicted, then the columns in
    ``keep``.  ``learn_on`` is over the labels' columns; only its rows are learned from (null: not held out)."""
    learns = F.coalesce(learn_on, F.lit(True))
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, learns, id_col, text_col, label_col, max_labels))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learns).alias("held_out"), F.col(text_col).alias("text"), *([F.struct(*[F.col(c) for c in keep]).alias("_keep")] if keep else []))

    def scored(batches):
        for batch in batches:
            for t in C.slices(batch, "text", SLICE):
                score = model.value.score(t["text"])
                t = t.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= 0.5).astype(np.int32)))
                yield from t.drop_columns(["text"]).to_batches()

    kept = f", _keep {rows.schema['_keep'].dataType.simpleString()}" if keep else ""
    out = rows.mapInArrow(scored, f"doc_id long, held_out boolean{kept}, score double, predicted int")
    return out.select("doc_id", "held_out", "score", "predicted", *[F.col("_keep")[c].alias(c) for c in keep])
