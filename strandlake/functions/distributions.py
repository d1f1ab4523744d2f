"""Tail probabilities, vectorised over columns of any length (Arrow batches)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by its series or its continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x > 0, np.nan, 0.0)
    low = (x > 0) & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term = total = 1 / al
        n = al.copy()
        for _ in range(100_000):
            n = n + 1
            term = term * xl / n
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-15).all():
                break
        out[low] = total * np.exp(-xl + al * np.log(xl) - _lgamma(al))
    high = (x > 0) & (x >= a + 1)
    if high.any():
        ah, xh = a[high], x[high]
        b, tiny = xh + 1 - ah, 1e-300
        c, d = np.full_like(b, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 100_000):
            an = -i * (i - ah)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        out[high] = 1 - np.exp(-xh + ah * np.log(xh) - _lgamma(ah)) * h
    return out


def poisson_cdf(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """P(X <= k)."""
    k, mean = np.asarray(k, float), np.asarray(mean, float)
    return np.where(k < 0, 0.0, 1 - gamma_p(np.maximum(np.floor(k), 0) + 1, mean))


@F.pandas_udf(T.DoubleType())
def poisson_lower(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X <= k) for a Poisson mean."""
    return pd.Series(poisson_cdf(k, mean))


@F.pandas_udf(T.DoubleType())
def poisson_upper(k: pd.Series, mean: pd.Series) -> pd.Series:
    """P(X > k)."""
    return pd.Series(1 - poisson_cdf(k, mean))


def chi2_tail_1(x: np.ndarray) -> np.ndarray:
    """Upper tail of chi-square with one degree of freedom."""
    return _erfc(np.sqrt(np.maximum(np.asarray(x, float), 0) / 2)) if np.size(x) else np.zeros(np.shape(x))


@F.pandas_udf(T.DoubleType())
def chi2_upper_1(x: pd.Series) -> pd.Series:
    """:func:`chi2_tail_1` of a column."""
    return pd.Series(chi2_tail_1(x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def gauss_upper(x: pd.Series) -> pd.Series:
    """Upper tail of the standard normal distribution."""
    return pd.Series(0.5 * _erfc(x.to_numpy(float) / math.sqrt(2)))


def binomial_two_sided(k: int, n: int) -> float:
    """Two-sided probability of a count at least as far from n/2, for p = 1/2."""
    low = min(k, n - k)
    tail = sum(math.comb(n, i) for i in range(low + 1)) / 2**n
    return min(1.0, 2 * tail)
