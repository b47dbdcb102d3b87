"""Tail probabilities for one-row-per-group results.

Spark has no distribution functions.  These run as vectorised UDFs on the few rows
that remain after aggregation, never on data rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


#: From this first parameter on, with a second one up to MANY, the incomplete gamma function gives the incomplete beta function.
HUGE, MANY = 5e5, 1e3
#: Steps after which a series that hasn't converged is an error instead of an answer.
STEPS = 1_000_000


def upper_gamma(s: float, z: float) -> float:
    """Regularised upper incomplete gamma function: series below s + 1, continued fraction above."""
    if z <= 0:
        return 1.0
    front = math.exp(s * math.log(z) - z - math.lgamma(s))
    if z < s + 1:
        term = total = 1 / s
        for n in range(1, STEPS):
            term *= z / (s + n)
            total += term
            if term < total * 1e-16:
                return 1 - front * total
    else:
        b = z + 1 - s
        c, d = 1e300, 1 / b
        value = d
        for n in range(1, STEPS):
            step = -n * (n - s)
            b += 2
            d = 1 / (step * d + b)
            c = b + step / c
            value *= c * d
            if abs(c * d - 1) < 1e-15:
                return front * value
    raise ArithmeticError(f"no convergence for s={s}, z={z}")


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function.

    By its continued fraction, which needs about sqrt(a + b) steps and loses digits to
    cancellation as a grows.  For a huge a and a moderate b it is the upper incomplete gamma
    function of b at -(a + (b - 1) / 2) ln x, with an error of order (b / a) ** 2.
    """
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    out[x <= 0], out[x >= 1] = 0.0, 1.0
    inner = (x > 0) & (x < 1) & (a > 0) & (b > 0)
    huge = inner & (a >= HUGE) & (b <= MANY)
    out[huge] = [upper_gamma(s, -(r + (s - 1) / 2) * math.log(v)) for r, s, v in zip(a[huge], b[huge], x[huge], strict=True)]
    inner = inner & ~huge
    if not inner.any():
        return out
    a, b, x = a[inner], b[inner], x[inner]
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, STEPS):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            value = value * change
        if np.all(np.abs(change - 1) < 1e-15):
            break
    else:
        raise ArithmeticError("the continued fraction did not converge")
    tail = front * value
    out[inner] = np.where(swap, 1 - tail, tail)
    return out


def f_upper(f, df1, df2) -> np.ndarray:
    """P(F > f)."""
    f, df1, df2 = (np.asarray(v, dtype=float) for v in (f, df1, df2))
    with np.errstate(invalid="ignore", divide="ignore"):
        swap = (df1 >= 2 * HUGE) & (df2 <= 2 * MANY)  # the same tail seen from the other side
        low = 1 - incomplete_beta(np.where(swap, df1 / 2, 1.0), np.where(swap, df2 / 2, 1.0), np.where(swap, df1 * f / (df2 + df1 * f), 0.5))
        return np.where(swap, low, incomplete_beta(np.where(swap, 1.0, df2 / 2), df1 / 2, np.where(swap, 0.5, df2 / (df2 + df1 * f))))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|)."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of an F statistic."""
    return pd.Series(f_upper(f, df1, df2))


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """Value below which a standard normal variable lies with chance p."""
    return p.map(NormalDist().inv_cdf)


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of a t statistic."""
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def f_two_sided(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Two-sided tail of a ratio of variances."""
    upper = f_upper(f, df1, df2)
    return pd.Series(np.minimum(1.0, 2 * np.minimum(upper, 1 - upper)))


# Polynomial coefficients of Royston (1995), highest power first.
LAST_WEIGHT = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0]
NEXT_WEIGHT = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
SMALL_MEAN = [-0.0006714, 0.025054, -0.39978, 0.5440]
SMALL_SPREAD = [-0.0020322, 0.062767, -0.77857, 1.3822]
LARGE_MEAN = [0.0038915, -0.083751, -0.31082, -1.5861]
LARGE_SPREAD = [0.0030302, -0.082676, -0.4803]


def shapiro(values: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and p for 3 to 5000 values."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    spread = float(((x - x.mean()) ** 2).sum())
    if n < 3 or n > 5000 or spread == 0:
        return math.nan, math.nan
    normal = NormalDist()
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        scores = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        norm = float(scores @ scores)
        u = 1 / math.sqrt(n)
        last = np.polyval(LAST_WEIGHT, u) + scores[-1] / math.sqrt(norm)
        if n <= 5:
            rest = (norm - 2 * scores[-1] ** 2) / (1 - 2 * last**2)
            ends = [last]
        else:
            near = np.polyval(NEXT_WEIGHT, u) + scores[-2] / math.sqrt(norm)
            rest = (norm - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * near**2)
            ends = [last, near]
        weights = scores / math.sqrt(rest)
        for i, w in enumerate(ends):
            weights[-1 - i], weights[i] = w, -w
    w = min(1.0, float(weights @ x) ** 2 / spread)
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return w, 1.0
    if n <= 11:
        inside = 0.459 * n - 2.273 - math.log(1 - w)
        if inside <= 0:
            return w, 0.0
        z = (-math.log(inside) - np.polyval(SMALL_MEAN, n)) / math.exp(np.polyval(SMALL_SPREAD, n))
    else:
        size = math.log(n)
        z = (math.log(1 - w) - np.polyval(LARGE_MEAN, size)) / math.exp(np.polyval(LARGE_SPREAD, size))
    return w, 0.5 * math.erfc(float(z) / math.sqrt(2))
