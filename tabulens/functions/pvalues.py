"""p-values for the small statistics tables (one row per feature or pair)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1 - x) / b


def p_correlation(r: float, n: float) -> float:
    """Two-sided p of a Pearson or Spearman coefficient."""
    if r is None or n is None or n < 3 or math.isnan(r):
        return float("nan")
    df = n - 2
    rest = max(0.0, 1 - r * r)
    return beta_inc(df / 2, 0.5, rest)


def p_anova(f: float, d1: float, d2: float) -> float:
    if f is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0 or math.isnan(f):
        return float("nan")
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def p_ks(stat: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    if stat is None or not n1 or not n2:
        return float("nan")
    lam = math.sqrt(n1 * n2 / (n1 + n2)) * stat
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([p_correlation(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def anova_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([p_anova(a, b, c) for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def ks_p(stat: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([p_ks(a, b, c) for a, b, c in zip(stat, n1, n2)], dtype="float64")
