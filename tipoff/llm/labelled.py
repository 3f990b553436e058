"""Bounded samples of labelled documents, and logistic helpers for fitted models."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tipoff.llm.common import held_out

SAMPLE = 20_000  # labelled documents a model is fitted on, at most


def training_labels(labels: DataFrame, target: str, *, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(id, y) of at most ``sample`` labelled documents outside the held-out fold, the first by a hash of the id.

    Null labels and ids are left out; of conflicting labels of one id the larger counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(target).isNotNull() & ~held_out(F.col(id_col)))
    one = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    mark = F.xxhash64("id")
    mark = F.xxhash64("id")
    return one.where(mark <= lowest(one.select(mark.alias("h")), sample)).orderBy(mark, "id").limit(sample)


def lowest(hashes: DataFrame, n: int) -> int:
    """A bound that the ``n`` lowest of ``hashes`` (a column h of longs) meet, and few others.

    One task sorts out the first ``n`` rows; with this, no more than a few times
    ``n`` rows get there. Counts when called.
    """
    share = 2 * n / max(hashes.count(), 1)
    while share < 0.5:
        bound = int((share - 0.5) * 2**64)
        if hashes.where(F.col("h") <= bound).count() >= n:
            return bound
        share *= 2
    return 2**63 - 1


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the first is the intercept) of a ridge-penalised logistic model, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        curvature = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curvature, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def predicted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")
