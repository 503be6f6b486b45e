"""Calibration and folds, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 4096


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing means of ``y`` (weights ``w``) over ascending ``x``."""
    means: list[float] = []
    weights: list[float] = []
    knots: list[list[float]] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist()):
        means.append(b)
        weights.append(c)
        knots.append([a])
        while len(means) > 1 and means[-2] >= means[-1]:
            m, v, k = means.pop(), weights.pop(), knots.pop()
            means[-1] = (means[-1] * weights[-1] + m * v) / (weights[-1] + v)
            weights[-1] += v
            knots[-1] += k
    xs, ys = [], []
    for k, m in zip(knots, means):
        xs += [k[0]] if k[0] == k[-1] else [k[0], k[-1]]
        ys += [m] if k[0] == k[-1] else [m, m]
    return np.array(xs), np.array(ys)


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Calibrated scores in [0, 1]; a thousandth follows the raw score, so its order is kept inside flat parts."""
    xs, ys = knots
    p = np.interp(raw, xs, ys) if len(xs) else np.full(len(raw), 0.5)
    return np.clip(0.999 * p + 0.001 / (1.0 + np.exp(-np.clip(raw, -30, 30))), 0.0, 1.0)


def inner_fold(doc_id: str, parts: int) -> Column:
    """Fold for out-of-fold scores, independent of the held-out rule."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("fold")), F.lit(parts)).cast("int")
