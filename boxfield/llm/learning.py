"""What the two classifiers share: the labelled sample and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, crc_remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, rows: int, *, doc_id="doc_id", text="text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out remainder, chosen by a hash of the id.

    The labels' table alone is sorted; its bounded head is joined to the documents.
    """
    known = labels.select(column(labels, doc_id).alias("__id"), column(labels, label).cast("int").alias("label")).where("__id is not null and label in (0, 1)")
    known = known.where(crc_remainder(F.col("__id"), mod) != held_out)
    chosen = known.orderBy(F.xxhash64("__id"), "label").limit(rows)
    texts = docs.select(column(docs, doc_id).alias("__id"), F.coalesce(column(docs, text).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", "label")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, *, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model (last: constant) by Newton steps; a class that is missing gives its rate alone."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    keep = np.full(len(w), ridge)
    keep[-1] = 0
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + keep * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 4 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w
