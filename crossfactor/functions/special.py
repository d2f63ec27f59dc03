"""Tail probabilities that SQL lacks, as Arrow UDFs meant for result rows (one per fit), never for observations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

_LGAMMA = np.vectorize(math.lgamma, otypes=[float])
_TINY = 1e-300


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    pos = x > 0
    front = np.zeros(a.shape)
    front[pos] = np.exp(a[pos] * np.log(x[pos]) - x[pos] - _LGAMMA(a[pos]))
    low = pos & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term = 1.0 / al
        total, n = term.copy(), al.copy()
        for _ in range(2000):
            n += 1
            term = term * xl / n
            total += term
            if np.all(np.abs(term) <= 1e-16 * np.abs(total)):
                break
        out[low] = 1.0 - front[low] * total
    high = pos & ~low
    if high.any():
        ah, xh = a[high], x[high]
        b = xh + 1 - ah
        c = np.full_like(b, 1 / _TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 2000):
            an = -i * (i - ah)
            b += 2
            d = 1 / np.where(np.abs(an * d + b) < _TINY, _TINY, an * d + b)
            c = np.where(np.abs(b + an / c) < _TINY, _TINY, b + an / c)
            step = d * c
            h *= step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[high] = front[high] * h
    return np.clip(out, 0.0, 1.0)


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, mirrored for fast convergence."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    mirror = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(mirror, b, a), np.where(mirror, a, b), np.where(mirror, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(
            _LGAMMA(aa + bb) - _LGAMMA(aa) - _LGAMMA(bb) + aa * np.log(xx) + bb * np.log1p(-xx)
        ) / aa
    front = np.where((xx <= 0) | (xx >= 1), 0.0, front)
    c = np.ones_like(xx)
    d = 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 500):
        for coef in (
            m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m)),
            -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1)),
        ):
            d = 1 + coef * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + coef / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    part = np.clip(front * h, 0.0, 1.0)
    return np.where(mirror, 1 - part, part)


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inverse of ``beta_cdf`` by bisection to double precision."""
    lo, hi = np.zeros(np.shape(a)), np.ones(np.shape(a))
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(a, b, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(chi2: pd.Series, ndof: pd.Series) -> pd.Series:
    """Upper chi-square tail; null where ndof is not positive."""
    ok = (ndof > 0) & chi2.notna()
    out = pd.Series(np.nan, index=chi2.index)
    out[ok] = gamma_tail(ndof[ok].to_numpy(float) / 2, chi2[ok].to_numpy(float) / 2)
    return out.where(ok, None)


_INTERVAL = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])


def _interval(k: np.ndarray, n: np.ndarray, alpha: np.ndarray, posterior: bool) -> pd.DataFrame:
    lower, upper = np.zeros(len(k)), np.ones(len(k))
    for a in np.unique(alpha):
        some = (alpha == a) & (n > 0)
        low = some & ((k > 0) | posterior)
        high = some & ((k < n) | posterior)
        lower[low] = beta_quantile(a / 2, k[low] + (1 if posterior else 0), n[low] - k[low] + 1)
        upper[high] = beta_quantile(1 - a / 2, k[high] + 1, n[high] - k[high] + (1 if posterior else 0))
    return pd.DataFrame({"lower": lower, "upper": upper})


@F.pandas_udf(_INTERVAL)
def clopper_pearson(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Exact binomial interval; (0, 1) when nothing was tried."""
    return _interval(k.to_numpy(float), n.to_numpy(float), alpha.to_numpy(float), posterior=False)


@F.pandas_udf(_INTERVAL)
def posterior_interval(k: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """Interval of Beta(k+1, n-k+1), the variant the mode analysis reports."""
    return _interval(k.to_numpy(float), n.to_numpy(float), alpha.to_numpy(float), posterior=True)


@F.pandas_udf(T.DoubleType())
def correlation_pvalue(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided Student-t p-value of a rank correlation; 1 below three points."""
    r, m = rho.fillna(0).to_numpy(float), n.to_numpy(float)
    ok = m >= 3
    df = np.where(ok, m - 2, 1.0)
    tail = beta_cdf(df / 2, np.full(len(r), 0.5), np.clip(1 - r * r, 0, 1))
    return pd.Series(np.where(ok, tail, 1.0))


@F.pandas_udf(T.DoubleType())
def kolmogorov_pvalue(d: pd.Series, n: pd.Series) -> pd.Series:
    """Asymptotic Kolmogorov tail with the small-sample correction of the argument."""
    root = np.sqrt(n.to_numpy(float))
    lam = (root + 0.12 + 0.11 / root) * d.to_numpy(float)
    j = np.arange(1, 101)[:, None]
    tail = 2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * (j * lam) ** 2), axis=0)
    return pd.Series(np.where(lam < 0.2, 1.0, np.clip(tail, 0, 1)))
