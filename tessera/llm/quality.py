"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U, hash_spans, labelled_sample, mix, parts, spans, utf8
from tessera.session import ship

BITS = 18
#: Rows that a model is fitted on at most, and passes over them.
TRAIN_ROWS, EPOCHS = 8_192, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
SCALE = 30.0


def _kinds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A word's shape: few, some or no capitals, small letters, digits and marks, and its last mark."""
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    mark = (data < 128) & ~upper & ~digit & ~((data >= 97) & (data <= 122))
    out = np.zeros(len(starts), U)
    size = ends - starts
    for m in (upper, digit, mark):
        sums = np.r_[0, np.cumsum(m)]
        n = sums[ends] - sums[starts]
        out = out * U(8) + np.minimum(n, 3).astype(U) + U(4) * (n == size)
    last = data[ends - 1]
    return out * U(256) + np.where(mark[ends - 1], last, 0).astype(U)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features in a row, where each text's begin): words, word pairs, and shapes of three words with repeats."""
    s, e, begins = spans(data, offsets)
    n = len(s)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    words = hash_spans(data, s, e)
    first = np.zeros(n, bool)
    first[begins[:-1][begins[:-1] < n]] = True
    # a text's first word follows nothing
    before = np.where(first, U(0), np.r_[U(0), words[:-1]])
    shape = mix(_kinds(data, s, e) * U(2) + (before == words).astype(U))
    shape1 = np.where(first, U(0), np.r_[U(0), shape[:-1]])
    shape2 = np.where(first, U(0), np.r_[U(0), shape1[:-1]])
    f = np.empty((n, 4), U)
    f[:, 0] = mix(words + U(1))
    f[:, 1] = mix(words * U(3) + before * U(0x9E3779B97F4A7C15) + U(2))
    f[:, 2] = mix(shape + U(3))
    f[:, 3] = mix(shape + shape1 * U(0x9E3779B97F4A7C15) + shape2 * U(0xC2B2AE3D27D4EB4F) + U(4))
    return (f >> U(64 - BITS)).astype(np.int64).ravel(), begins * 4


def _vectors(batches):
    """A row's distinct features and in which share of its n-grams each is."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        ids, shares = [], []
        for lo, hi in parts(offsets):
            f, begins = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            for a, b in zip(begins[:-1], begins[1:], strict=True):
                u, n = np.unique(f[a:b], return_counts=True)
                ids.append(u.astype(np.uint32).tobytes())
                shares.append((n / max(1, b - a)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["place", "label", "ids", "shares"])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """(weights, bias): FTRL-proximal with adaptive rates, a row at a time."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    last = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        sparse = np.where(at == last, 0.0, l1)
        return np.where(np.abs(own) <= sparse, 0.0, -(own - np.sign(own) * sparse) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for ids, shares, label in rows:
            at, x = np.append(ids.astype(np.int64), last), np.append(shares.astype(np.float64) * SCALE, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / alpha * w
    w = weights(np.arange(last + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _train(epochs: int):
    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        rows = [(np.frombuffer(i, np.uint32), np.frombuffer(x, np.float32), y) for i, x, y in zip(table["ids"].to_pylist(), table["shares"].to_pylist(), table["label"].to_pylist(), strict=True)]
        w, bias = ftrl(rows, epochs)
        return pa.Table.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    return train


def fit(docs: DataFrame, labels: DataFrame, label: str, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weights, bias) fitted on the `train_rows` labelled documents of smallest hash of their id (all, if there are fewer).

    Rows are turned into features where they lie; one task trains, on a bounded number of rows. 1 MB comes back.
    """
    ship(docs.sparkSession)
    texts = labelled_sample(docs, labels, label, train_rows).select(F.xxhash64("doc_id").alias("place"), "label", "text")
    vectors = texts.mapInArrow(_vectors, "place long, label int, ids binary, shares binary")
    rows = vectors.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_train(epochs), "weights binary, bias double").collect()
    if not rows:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(rows[0]["weights"], np.float32), rows[0]["bias"]


def _scores(model):
    def score(batches):
        weights, bias = model.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for lo, hi in parts(offsets):
                f, begins = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                sums = np.r_[0.0, np.cumsum(weights[f], dtype=np.float64)]
                out[lo:hi] = (sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(np.diff(begins), 1)
            p = 1 / (1 + np.exp(-np.clip(out * SCALE + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of docs: doc_id and score, the probability of label 1.

    labels (doc_id, label) holds the rows that may be learned from. Only doc_id and text of docs are read. A null or
    empty text gets the score of the bias alone; null and repeated ids are rows like others, but for training a null id
    or label is passed over, a doc_id labelled twice has the larger label, and of texts that share a doc_id one counts.
    Without labels every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, train_rows, epochs))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scores(model), "doc_id long, score double")
