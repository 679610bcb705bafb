"""Labelled rows for the two classifiers, and the calibration of their scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, texts
from .graph import bloom, bloom_has, bloom_slot, bloom_width

#: Labels are broadcast up to this many rows (about 50 MB in a task); beyond, documents and labels are joined by a shuffle, of documents that pass a bit set of the labels' ids.
BROADCAST_LABELS = 1_000_000


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, folds: int, held: int) -> DataFrame:
    """(doc_id, text, label, n_bytes of the text) of the documents with a label, without those whose fold is ``held``.

    Null ids and labels take no part; of an id's different labels the largest counts.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[column].cast("int").alias("label")).dropna()
    known = known.filter(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows, n = texts(docs), labels.count()
    # counted here, so that what asks for sizes alone moves no text
    rows = rows.withColumn("n_bytes", F.octet_length("text"))
    known = F.broadcast(known) if n <= BROADCAST_LABELS else known
    if n > BROADCAST_LABELS:
        rows = _with_id_in(rows, known, n)
    return rows.join(known, "doc_id").select("doc_id", "text", (F.col("label") > 0).cast("int").alias("label"), "n_bytes")


def _with_id_in(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The rows whose doc_id is one of at most n in known, and few others: so the texts of the others are not moved."""
    width = bloom_width(n)
    bits = rows.sparkSession.sparkContext.broadcast(bloom(known, "doc_id", width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom_has(bits.value, batch.column("slot").to_numpy()))).select(["doc_id", "text", "n_bytes"])

    return rows.filter("doc_id IS NOT NULL").withColumn("slot", bloom_slot(F.col("doc_id"), width)).mapInArrow(run, "doc_id long, text string, n_bytes int")


def sampled(rows: DataFrame, limit: int) -> DataFrame:
    """At most about ``limit`` rows, chosen by a hash of the id; all rows if they are fewer."""
    n = rows.count()
    if n <= limit:
        return rows
    scale = 1 << 30
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * limit / n))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """(slopes..., intercept) of P(y = 1 | columns of x), by Newton steps with a small ridge on the scaled columns;
    smoothed targets keep the weights finite."""
    n, k = x.shape
    n1 = float(y.sum())
    n0 = n - n1
    if not n1 or not n0:
        return np.append(np.zeros(k), np.log((n1 + 0.5) / (n0 + 0.5)))
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.concatenate([x / scale, np.ones((n, 1))], 1)
    w = np.append(np.zeros(k), np.log((n1 + 1) / (n0 + 1)))
    keep = np.diag(np.append(np.full(k, ridge), 1e-9))
    for _ in range(100):
        p = sigmoid(a @ w)
        grad = a.T @ (p - target) + keep @ w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + keep, grad)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
