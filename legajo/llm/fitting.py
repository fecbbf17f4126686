"""Bounded samples of labelled rows and a small logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import fold, text_bytes


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    max_rows: int,
    folds: int,
    held_out: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, label, text) of at most ``max_rows`` labelled documents outside the held-out fold.

    The rows are those with the smallest hash of the id, so the sample is the
    same in every run.  Null ids and labels are left out; of several labels of
    one document the largest counts.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .filter(fold(id_col, folds) != held_out)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    # at most max_rows rows of two numbers
    return docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).join(
        F.broadcast(chosen), F.col("id") == F.col("_id")
    ).select("id", "label", "text")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression by Newton steps.

    Columns should be of comparable size.  Without rows all weights are zero.
    """
    design = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(design.shape[1])
    penalty = ridge * np.eye(design.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (p - y) + penalty @ weights
        curve = (design * (p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(curve, gradient)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
