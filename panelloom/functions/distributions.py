"""Normal and t probabilities for rows that are already aggregated."""

from __future__ import annotations

from collections.abc import Callable
from math import exp, inf, lgamma, log
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_t(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def _column(work) -> Callable[..., Column]:
    """A column function of a pandas function, made when it is first used: types need a session."""
    return lambda *args: F.pandas_udf(work, "double")(*args)


def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else two_sided_t(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def _cdf(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else _NORMAL.cdf(x) for x in z], dtype="float64")


def _ppf(p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else (-inf if x <= 0 else inf if x >= 1 else _NORMAL.inv_cdf(x)) for x in p], dtype="float64")


t_p_value, normal_cdf, normal_ppf = _column(_t), _column(_cdf), _column(_ppf)
