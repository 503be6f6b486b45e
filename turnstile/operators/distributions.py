"""Outcome distributions over integer classes, as arrays of probabilities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import kept
from .quantiles import percentiles


def negative_binomial(mu: Column, r: Column, low: int, high: int) -> Column:
    """Truncated and renormalised probabilities of low..high; Poisson where the variance hardly exceeds the mean.

    Truncation cancels the normalising terms, so ratios of neighbouring classes are enough:
    their logs are accumulated, for a batch of rows at once, and shifted by the maximum.
    """
    k = np.arange(max(high, 0), dtype=float)

    @F.pandas_udf("array<double>")
    def run(m: pd.Series, d: pd.Series) -> pd.Series:
        mu_, r_ = m.to_numpy(float)[:, None], d.to_numpy(float)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            poisson = mu_ * mu_ / r_ < 0.01 * np.maximum(mu_, 1e-12)
            step = np.where(poisson, np.log(mu_) - np.log(k + 1), np.log((k + r_) / (k + 1)) + np.log(mu_ / (r_ + mu_)))
        logs = np.concatenate([np.zeros((len(mu_), 1)), np.cumsum(step, 1)], 1)[:, max(low, 0) : high + 1]
        w = np.exp(logs - logs.max(1, keepdims=True))
        p = np.concatenate([np.zeros((len(w), max(-low, 0))), w / w.sum(1, keepdims=True)], 1)
        missing = (m.isna() | d.isna()).to_numpy()
        return pd.Series([None if no else x for no, x in zip(missing, p)])

    return run(mu, r)


def fit_dispersion(rows: DataFrame, mean: str, count: str, by: list[str] = (), least: float = 0.01) -> DataFrame:
    """(by..., r): the likeliest dispersion of counts with given means.

    The likelihood needs each (mean, count) pair once: pairs are counted first, so a task
    sees the distinct pairs of a group, not its rows.
    """
    pairs = rows.where((F.col(mean) > 0) & F.col(count).isNotNull()).groupBy(*by, F.col(mean).cast("double").alias("__m"), F.col(count).cast("long").alias("__y")).agg(F.count("*").alias("__n"))

    def best(f: pd.DataFrame) -> pd.DataFrame:
        m, y, n = (f[c].to_numpy(float) for c in ("__m", "__y", "__n"))
        lg = np.vectorize(math.lgamma)

        def loss(logr):
            r = math.exp(logr)
            return -float((n * (lg(y + r) - math.lgamma(r) - lg(y + 1) + r * np.log(r / (r + m)) + y * np.log(np.maximum(m, 1e-12) / (r + m)))).sum())

        lo, hi = math.log(least), math.log(1e6)
        g = (math.sqrt(5) - 1) / 2
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        fa, fb = loss(a), loss(b)
        for _ in range(80):
            if fa < fb:
                hi, b, fb = b, a, fa
                a = hi - g * (hi - lo)
                fa = loss(a)
            else:
                lo, a, fa = a, b, fb
                b = lo + g * (hi - lo)
                fb = loss(b)
        return pd.DataFrame({**{c: [f[c].iloc[0]] for c in by}, "r": [max(least, math.exp((lo + hi) / 2))]})

    keys = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in by)
    return pairs.groupBy(*(by or [F.lit(1)])).applyInPandas(best, f"{keys}, r double" if by else "r double")


def _phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def normal(mean: Column, sigma: float, low: int, high: int) -> Column:
    """P(k) as the normal mass between k - 0.5 and k + 0.5, not renormalised."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        edges = np.arange(low, high + 2) - 0.5
        return pd.Series(list(np.diff(_phi((edges[None, :] - m.to_numpy(float)[:, None]) / sigma), axis=1)))

    return run(mean)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def student_cdf(x: float, df: float) -> float:
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + x * x))
    return 1 - half if x > 0 else half


def incomplete_betas(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """``incomplete_beta`` of many numbers, each until its fraction has converged."""
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    at = np.flatnonzero((x > 0) & (x < 1))
    x = x.ravel()[at]
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(y), 1.0 / np.maximum(1 - (p + q) * y / (p + 1), 1e-300)
    value, got, left = np.empty_like(y), d.copy(), np.arange(len(y))
    for m in range(1, 300):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1.0 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
            got = got * c * d
        done = np.abs(c * d - 1) < 1e-14
        if m == 299 or not len(left):
            done[:] = True
        if done.any():
            value[left[done]] = got[done]
            on = ~done
            p, q, y, c, d, got, left = p[on], q[on], y[on], c[on], d[on], got[on], left[on]
    value *= front
    out.ravel()[at] = np.where(swap, 1.0 - value, value)
    return out


def student_t(mean: Column, sigma: Column, df: float, low: int, high: int) -> Column:
    """Mass of a scaled Student t around each class, renormalised."""
    if df <= 2:
        raise ValueError("more than two degrees of freedom are needed")

    @F.pandas_udf("array<double>")
    def run(m: pd.Series, s: pd.Series) -> pd.Series:
        edges = np.arange(low, high + 2) - 0.5
        with np.errstate(all="ignore"):
            x = (edges[None, :] - m.to_numpy(float)[:, None]) / s.to_numpy(float)[:, None]
            half = 0.5 * incomplete_betas(df / 2, 0.5, df / (df + x * x))
            p = np.diff(np.where(x > 0, 1 - half, half), axis=1)
            total = p.sum(1, keepdims=True)
            return pd.Series(list(np.where(total > 0, p / total, 1.0 / p.shape[1])))

    return run(mean, sigma)


def cell_sigmas(rows: DataFrame, prediction: str, target: str, cells: int = 5, least_rows: int = 30, least: float = 1e-3) -> tuple[list[float], list[float], float]:
    """Quantile edges of the predictions, a robust residual scale for each cell, and the global one."""
    res = rows.select(F.col(prediction).alias("p"), (F.col(target) - F.col(prediction)).alias("e")).where("p IS NOT NULL AND e IS NOT NULL")
    with kept(res) as res:
        edges = percentiles(res, F.col("p"), [k / cells for k in range(1, cells)])[()]
        cell = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda c: c < F.col("p")))
        res = res.withColumn("cell", cell)
        middle = lambda d, x, by=(): {k[0] if by else None: v[0] for k, v in percentiles(d, x, [0.5], by).items()}
        centre = middle(res, F.col("e"), ["cell"])
        far = F.abs(F.col("e") - F.element_at(F.create_map(*[F.lit(x) for kv in centre.items() for x in kv]), F.col("cell")))
        mad = middle(res, far, ["cell"])
        got = {r["cell"]: r for r in res.groupBy("cell").agg(F.stddev("e").alias("sd"), F.count("*").alias("n")).collect()}  # a row a cell
        whole = 1.4826 * middle(res, F.abs(F.col("e") - F.lit(middle(res, F.col("e"))[None])))[None]
        whole = max(whole or res.agg(F.stddev("e")).first()[0] or least, least)
        return edges, [max((1.4826 * mad[k] or got[k]["sd"] or least), least) if k in got and got[k]["n"] >= least_rows else whole for k in range(cells)], whole


@dataclass(frozen=True)
class StudentT:
    """Student t around predictions, with robust scales by cells of the predictions. ``divide``: the unit of a class."""

    prediction: str
    target: str
    low: int
    high: int
    degrees: float = 5.0
    cells: int = 5
    least_rows: int = 30
    divide: float = 1.0
    output: str = "distribution"

    def fit(self, rows: DataFrame) -> FittedStudentT:
        edges, sigmas, _ = cell_sigmas(rows, self.prediction, self.target, self.cells, self.least_rows)
        return FittedStudentT(self, edges, sigmas)


@dataclass(frozen=True)
class FittedStudentT:
    model: StudentT
    edges: list
    sigmas: list

    def transform(self, df: DataFrame) -> DataFrame:
        m, p = self.model, F.col(self.model.prediction)
        cell = F.size(F.filter(F.lit(self.edges).cast("array<double>"), lambda c: c < p))
        sigma = F.element_at(F.lit(self.sigmas).cast("array<double>"), cell + 1) / m.divide
        return df.withColumn(m.output, student_t(p / m.divide, sigma, m.degrees, m.low, m.high))
