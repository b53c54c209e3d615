"""Bounded samples of labelled rows, and held-out measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, fold

#: Most labelled documents that a classifier learns from; which ones is a hash of their ids.
MAX_TRAINING_ROWS = 20_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, text and label (0 or 1) of up to ``max_rows`` labelled documents outside the held-out fold.

    The ids number ``max_rows`` at most, which bounds what the join broadcasts. Documents
    with several label rows take the larger one; null ids and labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).dropna()
    known = known.filter(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = cut(known.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))))
    n = known.count()
    if n > 2 * max_rows:  # the smallest places are all below this one, so few rows are sorted
        known = known.filter(F.col("place") < int((1 << 40) * 1.5 * max_rows / n))
    sample = known.orderBy("place", "doc_id").limit(max_rows).drop("place")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(cut(sample)), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w -= np.linalg.solve(hessian, gradient)
    return w


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties at half."""
    _, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    positive = y > 0
    n, m = positive.sum(), (~positive).sum()
    return float((rank[positive].sum() - n * (n + 1) / 2) / (n * m))
