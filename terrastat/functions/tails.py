"""Tail areas of Student t, F and chi-square.

Spark has no such built-ins; these are Arrow functions over numpy, meant for
result tables (tests and contrasts).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def _each(fn, x):
    x = np.asarray(x, float)
    return np.array([fn(v) for v in x.ravel()]).reshape(x.shape)


def _lgamma(x):
    return _each(math.lgamma, x)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, float) for v in (a, b, x)])
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        direct = x < (a + 1.0) / (a + b + 2.0)
        xs = np.where(direct, x, 1.0 - x)
        aa, bb = np.where(direct, a, b), np.where(direct, b, a)
        part = front * _beta_fraction(aa, bb, xs) / aa
        out = np.where(direct, part, 1.0 - part)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
    return out


def f_tail(f, d1, d2):
    f, d1, d2 = (np.minimum(np.asarray(v, float), 1e300 if v is f else 1e9) for v in (f, d1, d2))
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * np.maximum(f, 0.0)))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.minimum(np.asarray(df, float), 1e9)
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def chi2_tail(x, df):
    """Upper incomplete gamma Q(df/2, x/2): series below the mean, fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    z, a = np.maximum(x, 0.0) / 2.0, df / 2.0
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(-z + a * np.log(z) - _lgamma(a))
        total = term = 1.0 / a
        for k in range(1, 2000):
            term = term * z / (a + k)
            total = total + term
            if np.all((term < total * 1e-16) | (z >= a + 1)):
                break
        series = 1.0 - front * total
        b = z + 1.0 - a
        c = np.full_like(z, 1.0 / TINY)
        d = 1.0 / np.where(np.abs(b) < TINY, TINY, b)
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - a)
            b = b + 2.0
            d = an * d + b
            d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
            if np.all((np.abs(d * c - 1.0) < 1e-15) | (z < a + 1)):
                break
        out = np.where(z < a + 1, series, front * h)
    return np.where(z <= 0, 1.0, out)


def t_critical(alpha: float, df):
    """Two-sided critical values of Student t, by bisection on the tail."""
    df = np.minimum(np.asarray(df, float), 1e9)  # beyond that the normal distribution, to all digits
    lo, hi = np.zeros_like(df), np.full_like(df, 1e6)
    for _ in range(75):
        mid = (lo + hi) / 2.0
        above = t_two_sided(mid, df) > alpha
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2.0


def _masked(fn, *series):
    frame = pd.concat([s.astype("float64") for s in series], axis=1)
    ok = frame.notna().all(axis=1).to_numpy()
    out = np.full(len(frame), np.nan)
    if ok.any():
        out[ok] = fn(*[frame.iloc[ok, i].to_numpy() for i in range(frame.shape[1])])
    return pd.Series(out).astype(object).where(ok, None).astype("Float64")


@F.pandas_udf(DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return _masked(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def f_test_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _masked(f_tail, f, d1, d2)


@F.pandas_udf(DoubleType())
def chi2_test_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _masked(chi2_tail, x, df)
