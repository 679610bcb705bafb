"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Features of a text are the distinct byte 4-grams and the distinct 6-grams of character classes (upper, lower, digit,
space, line end, other letter, and every mark by itself), each hashed to one of 2**18 places. Class log-count ratios
of the indicators are counted over all labelled training rows in one distributed aggregation. A linear
hinge-loss model over the indicators scaled by these ratios is then fitted by dual coordinate descent on at
most ``sample`` training rows chosen by a hash of their ids, and a logistic curve, fitted on rows of the sample
that the model did not see, maps its margins to scores.

Null and empty texts have no features and get the score of margin 0. Every row of documents gives one row. Without
labels of both classes every score is the share of label 1 (0.5 without any). Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, released, table, texts
from .labelled import labelled_texts, logistic, sampled, sigmoid
from .wordhash import buffers

BITS = 18
SAMPLE = 6000
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[[10, 11, 12, 13]] = 5
_CLASS[128:] = 6
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - BITS)


class Features:
    """Distinct feature places of one text after another; keeps one scratch array for all."""

    def __init__(self) -> None:
        self.mark = np.zeros(1 << BITS, np.int64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        if not len(data):
            return np.zeros(0, np.int64)
        b = data.astype(np.uint64)
        c = _CLASS[data]
        places = np.concatenate([_grams(b, 4, 8, _M1), _grams(c, 6, 8, _M2)])
        order = np.arange(len(places))
        self.mark[places] = order
        return places[self.mark[places] == order]


def _grams(x: np.ndarray, n: int, bits: int, mul: np.uint64) -> np.ndarray:
    n = min(n, len(x))
    h = np.zeros(len(x) - n + 1, np.uint64)
    for i in range(n):
        h |= x[i : i + len(h)] << np.uint64(bits * i)
    h = h * mul
    h ^= h >> np.uint64(29)
    return ((h * _M2) >> _SHIFT).astype(np.int64)


def _each(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    offsets, data = buffers(batch.column("text"))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def log_count_ratios(rows: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """ln of how much larger each feature's share of the indicators is in class 1 than in class 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for label, data in zip(batch.column("label").to_pylist(), _each(batch), strict=True):
                total[label, features(data)] += 1
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"place": used.astype(np.int32), "n0": total[0, used].astype(np.int32), "n1": total[1, used].astype(np.int32)})

    rows = rows.select("text", "label").mapInArrow(released(count), "place int, n0 int, n1 int")
    got = rows.groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most 2**BITS rows
    n = np.full((2, 1 << BITS), alpha)
    place = got.column("place").to_numpy()
    n[0, place] += got.column("n0").to_numpy()
    n[1, place] += got.column("n1").to_numpy()
    return np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())


def scaled(ratios: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The text's indicators times their ratios, at unit length."""
    x = ratios[places]
    return x / (float(np.sqrt((x * x).sum())) or 1.0)


def dual_coordinate_descent(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float = 1.0, epochs: int = 20, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L1-loss linear support vector machine; y is -1 or 1. Classes weigh the same in total."""
    cost = np.where(y > 0, c * len(y) / (2 * max(1, (y > 0).sum())), c * len(y) / (2 * max(1, (y < 0).sum())))
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(xs))
    norm = np.array([float((v * v).sum()) + 1 for _, v in xs])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(xs)):
            place, v = xs[i]
            g = y[i] * (float(w[place] @ v) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[place] += step * v
                bias += step
                worst = max(worst, abs(step))
        if worst < tol:
            break
    return w, bias


def nbsvm_scores(docs: DataFrame, labels: DataFrame, column: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rows = labelled_texts(docs, labels, column, folds, held)
    ratios = log_count_ratios(rows)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            got = [features(d).astype(np.int32) for d in _each(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(got, pa.list_(pa.int32()))], ["doc_id", "label", "places"])

    got = sampled(rows, sample).mapInArrow(released(featurize), "doc_id long, label int, places array<int>").toArrow().sort_by("doc_id")
    y = got.column("label").to_numpy().astype(float) * 2 - 1
    lists = got.column("places").combine_chunks()
    flat, off = lists.flatten().to_numpy(), np.asarray(lists.offsets)
    xs = [(p, scaled(ratios, p)) for p in (flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True))]
    if len(set(y)) == 2:
        check = np.arange(len(xs)) % 3 == 0
        w, bias = dual_coordinate_descent([x for x, k in zip(xs, check, strict=True) if not k], y[~check], 1 << BITS)
        margin = np.array([float(w[p] @ v) + bias for (p, v), k in zip(xs, check, strict=True) if k])
        slope, shift = logistic(margin[:, None], (y[check] > 0).astype(float))
    else:
        w, bias, slope, shift = np.zeros(1 << BITS), 0.0, 0.0, float(np.log(((y > 0).sum() + 0.5) / ((y < 0).sum() + 0.5)))
    model = docs.sparkSession.sparkContext.broadcast(((w * ratios).astype(np.float32), ratios.astype(np.float32), bias, slope, shift))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        weight, ratio, bias, slope, shift = model.value
        for batch in batches:
            out = []
            for data in _each(batch):
                p = features(data)
                x = ratio[p]
                out.append(float(weight[p].sum(dtype=float)) / (float(np.sqrt((x * x).sum(dtype=float))) or 1.0) + bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(slope * np.array(out, float) + shift))], ["doc_id", "score"])

    out = texts(docs).mapInArrow(released(score), "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return nbsvm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
