"""Distribution functions for tests and intervals, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (modified Lentz steps)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    swap = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1.0 - (p + q) * z / (p + 1.0)
        d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 400):
            for coef in (
                m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1.0 + coef * d
                d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1.0 + coef / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(~np.isfinite(h) | (np.abs(c * d - 1.0) < 1e-15)):
                break
        out = front * h
    out = np.where(z <= 0.0, 0.0, out)
    return np.where(swap, 1.0 - out, out)


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    with np.errstate(all="ignore"):
        scale = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1.0 / a
        total = term.copy()
        for k in range(1, 500):
            term = term * x / (a + k)
            total = total + term
        lower = np.clip(scale * total, 0.0, 1.0)
        b = x + 1.0 - a
        c = np.full_like(b, 1e300)
        d = 1.0 / b
        h = d.copy()
        for i in range(1, 300):
            an = -i * (i - a)
            b = b + 2.0
            d = 1.0 / (an * d + b)
            c = b + an / c
            h = h * d * c
        upper = scale * h
    return np.where(x <= 0, 1.0, np.where(x < a + 1.0, 1.0 - lower, upper))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    with np.errstate(all="ignore"):
        out = beta_inc(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))
    return np.where(np.isfinite(t) & (df > 0), out, np.nan)


def t_quantile(p: float, df) -> np.ndarray:
    """Upper quantile (p > 0.5) by bisection on the two-sided tail."""
    df = np.asarray(df, dtype=float)
    tail = 2.0 * (1.0 - p)
    lo, hi = np.zeros_like(df), np.full_like(df, 1e3)
    for _ in range(80):
        mid = (lo + hi) / 2.0
        above = t_two_sided(mid, df) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(df > 0, (lo + hi) / 2.0, np.nan)


def f_quantile(p: float, df1: float, df2: float) -> float:
    """The value that an F variable stays below with probability ``p``, by bisection on the incomplete beta function."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        z = (lo + hi) / 2
        below = float(beta_inc(np.array([df1 / 2.0]), np.array([df2 / 2.0]), np.array([z]))[0]) < p
        lo, hi = (z, hi) if below else (lo, z)
    return df2 * lo / (df1 * max(1.0 - lo, 1e-300))


def _nullable(values) -> pd.Series:
    out = pd.Series(np.asarray(values, dtype=float))
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic."""
    return _nullable(t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, df1, df2))
    return _nullable(beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution."""
    x, df = np.asarray(x, dtype=float), np.asarray(df, dtype=float)
    return _nullable(gamma_upper(df / 2.0, x / 2.0))


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic."""
    return _nullable(_erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return _nullable(0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2.0)))


def t_multiplier(df_col, conf: float = 0.95):
    """Half-width multiplier of a two-sided confidence interval."""

    @F.pandas_udf(T.DoubleType())
    def inner(df: pd.Series) -> pd.Series:
        return _nullable(t_quantile(0.5 + conf / 2.0, df))

    return inner(df_col)


@F.pandas_udf(T.DoubleType())
def hypergeometric_mid_upper(k: pd.Series, drawn: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    """P(X > k) + P(X = k) / 2 for the marked items among ``drawn`` taken from ``total``."""

    def log_choose(n, r):
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    cache: dict[tuple[int, int, int, int], float] = {}

    def tail(x: int, n: int, m: int, big: int) -> float:
        key = (x, n, m, big)
        if key not in cache:
            base = log_choose(big, n)
            top = min(n, m)
            i = np.arange(x, top + 1)
            logs = np.array([log_choose(m, j) + log_choose(big - m, n - j) - base for j in i if n - j <= big - m])
            probs = np.exp(logs)
            cache[key] = float(probs.sum() - probs[0] / 2.0) if len(probs) else 0.0
        return cache[key]

    return pd.Series([tail(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, drawn, marked, total)])
