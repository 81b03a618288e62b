"""Logistic regression by follow-the-regularised-leader updates on sparse rows.

The model is fitted in one task on a bounded sample: the caller states the bound on its rows. Rows are taken in
the order of their ids, so the same rows give the same weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPARSE = "struct<at:array<int>,by:array<float>>"


def fit(rows, width: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """Weights, the bias last. Each row: label, feature numbers, feature values.

    The log odds of the labels are an offset of every prediction, so that weights only tell what departs from them.
    """
    ones = sum(y for y, _, _ in rows)
    offset = np.log((ones + 0.5) / (len(rows) - ones + 0.5)) if rows else 0.0
    z, n = np.zeros(width + 1), np.zeros(width + 1)
    order = np.random.default_rng(0)
    if not rows:
        return np.zeros(width + 1)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, at, x = rows[k]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(offset + w @ x, -35, 35)))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[at] = ni + g * g
    root = np.sqrt(n)
    weights = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + root) / alpha + l2))
    weights[width] += offset
    return weights


def fitted(sample: DataFrame, width: int, **options) -> np.ndarray:
    """Weights from rows (doc_id, label, x: SPARSE)."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            x = batch.column("x")
            at, by = x.field("at"), x.field("by")
            ends = at.offsets.to_numpy()
            at, by = at.values.to_numpy(), by.values.to_numpy()
            for k, (i, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist())):
                own = slice(ends[k], ends[k + 1])
                rows.append((str(i), y, np.append(at[own], np.int32(width)), np.append(by[own], np.float32(1))))
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        weights = fit([r[1:] for r in rows], width, **options)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()])], ["weights"])

    row = sample.select("doc_id", "label", "x").repartition(1).mapInArrow(train, "weights binary").first()
    return np.frombuffer(row[0], np.float32) if row else np.zeros(width + 1, np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, doc_id: str, text: str) -> DataFrame:
    """Texts of at most `most` labelled ids, chosen by a hash of the id; repeated ids give their least text."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers
        .groupBy("doc_id", "label")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
