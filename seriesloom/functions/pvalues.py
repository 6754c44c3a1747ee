"""Tail probabilities and t quantiles, evaluated on already aggregated statistics.

Spark SQL has no error function or incomplete beta/gamma function, so these are Arrow UDFs over numpy arrays. They
only ever see one row per test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300
#: Terms after which a series that has not converged gives NULL instead of a number.
TERMS = 20_000
#: Shape from which the gamma tail uses its uniform expansion (absolute error below 1e-9), and degrees of freedom from
#: which a t statistic is turned into a normal deviate (below 1e-10).
LARGE_SHAPE, LARGE_DF = 1e4, 1e5


def _guard(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < _TINY, _TINY, v)


def _log_gamma_step(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """lgamma(p + q) - lgamma(p), for p of 100 or more from Stirling's series, whose large terms cancel on paper."""
    big = np.maximum(p, 100.0)
    rest = (1 / (big + q) - 1 / big) / 12 - ((big + q) ** -3 - big**-3) / 360
    series = (big - 0.5) * np.log1p(q / big) + q * np.log(big + q) - q + rest
    return np.where(p >= 100, series, _lgamma(p + q) - _lgamma(p))


def _settled(ratio: np.ndarray) -> bool:
    return bool(np.nanmax(np.abs(ratio - 1), initial=0.0) < 1e-14)


def _beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b): modified Lentz evaluation of the continued fraction."""
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    large, small = np.maximum(p, q), np.minimum(p, q)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma_step(large, small) - _lgamma(small) + p * np.log(z) + q * np.log1p(-z)) / p
    c = np.ones_like(z)
    d = 1 / _guard(1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, TERMS):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
                    -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _guard(1 + num * d)
            c = _guard(1 + num / c)
            h = h * d * c
        if _settled(d * c):
            break
    else:
        h = np.where(np.abs(d * c - 1) < 1e-14, h, np.nan)
    part = np.where(z <= 0, 0.0, front * h)
    return np.where(swap, 1 - part, part)


def _gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(x, 0.0))
    out, large = np.empty(a.shape), a >= LARGE_SHAPE
    out[large] = _gamma_tail_large(a[large], x[large])
    out[~large] = _gamma_tail_small(a[~large], x[~large])
    return np.clip(out, 0.0, 1.0)


def _gamma_tail_large(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Temme's uniform expansion with its first correction."""
    m = x / a - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = m - np.log1p(m)
        near = m * m * (0.5 - m * (1 / 3 - m * (0.25 - m * (0.2 - m / 6))))
        eta = np.sign(m) * np.sqrt(2 * np.where(np.abs(m) < 1e-3, near, exact))
        first = np.where(np.abs(m) < 1e-3, -1 / 3 + eta / 12 - 2 * eta**2 / 135, 1 / m - 1 / eta)
        tail = 0.5 * _erfc(eta * np.sqrt(a / 2)) + np.exp(-a * eta**2 / 2) / np.sqrt(2 * np.pi * a) * first
    return np.where(x <= 0, 1.0, np.where(np.isinf(x), 0.0, tail))


def _gamma_tail_small(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Power series below a + 1, continued fraction above."""
    low = x < a + 1
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        scale = np.where(np.isinf(x), 0.0, np.exp(-x + a * np.log(np.maximum(x, _TINY)) - _lgamma(a)))
        inside = np.where(low, x, 0.0)
        term, total = 1 / a, 1 / a
        for k in range(1, TERMS):
            term = term * inside / (a + k)
            total = total + term
            if (term <= 1e-16 * total).all():
                break
        beyond = np.where(low | np.isinf(x), a + 2, x)
        b = beyond + 1 - a
        c = np.full_like(b, 1 / _TINY)
        d = 1 / _guard(b)
        h = d.copy()
        for k in range(1, TERMS):
            num = -k * (k - a)
            b = b + 2
            d = 1 / _guard(num * d + b)
            c = _guard(b + num / c)
            h = h * d * c
            if _settled(d * c):
                break
        else:
            h = np.where(np.abs(d * c - 1) < 1e-14, h, np.nan)
    return np.where(low, 1 - scale * total, scale * h)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    finite = np.where(np.isinf(t), 1.0, t)
    deviate = (8 * df + 1) / (8 * df + 3) * np.sqrt(df * np.log1p(finite**2 / df))
    kept = np.minimum(df, LARGE_DF)
    tail = np.where(df > LARGE_DF, _erfc(deviate / math.sqrt(2)), _beta_tail(kept / 2, np.full_like(kept, 0.5), kept / (kept + finite**2)))
    return np.where(np.isinf(t), 0.0, tail)


def t_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """Upper quantile by bisection on the two-sided tail."""
    lo, hi, tail = np.zeros_like(df), np.full_like(df, 1e4), 2 * (1 - p)
    for _ in range(70):
        mid = (lo + hi) / 2
        above = t_two_sided(mid, df) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def kolmogorov_tail(x: np.ndarray) -> np.ndarray:
    k = np.arange(1, 101)[:, None]
    series = 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * x[None, :] ** 2), axis=0)
    return np.where(x < 0.2, 1.0, np.clip(series, 0.0, 1.0))


def _column_udf(fn):
    @F.pandas_udf("double")
    def run(stat: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        s, x, y = (v.to_numpy(dtype=float, na_value=np.nan) for v in (stat, a, b))
        out = np.full(len(s), np.nan)
        ok = ~np.isnan(s) & (x > 0) & ~np.isnan(y)
        if ok.any():
            out[ok] = fn(s[ok], x[ok], y[ok])
        return pd.Series(out).where(~np.isnan(out), None)

    return run


def p_value(kind: str, stat: Column, df1: Column | None = None, df2: Column | None = None) -> Column:
    """kind: `normal` and `t` are two-sided, `normal_greater`, `chi2` and `f` are upper tails, `ks` is asymptotic."""
    one = F.lit(1.0)
    fns = {
        "normal": lambda s, x, y: _erfc(np.abs(s) / math.sqrt(2)),
        "normal_greater": lambda s, x, y: 0.5 * _erfc(s / math.sqrt(2)),
        "t": lambda s, x, y: t_two_sided(np.abs(s), x),
        "chi2": lambda s, x, y: _gamma_tail(x / 2, s / 2),
        "f": lambda s, x, y: _beta_tail(y / 2, x / 2, y / (y + x * np.maximum(s, 0.0))),
        "ks": lambda s, x, y: kolmogorov_tail(s),
    }
    args = [c.cast("double") for c in (stat, df1 if df1 is not None else one, df2 if df2 is not None else one)]
    return _column_udf(fns[kind])(*args)


def t_critical(df: Column, p: float = 0.975) -> Column:
    return _column_udf(lambda s, x, y: t_quantile(p, x))(F.lit(0.0), df.cast("double"), F.lit(1.0))
