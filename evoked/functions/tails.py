"""Tails of the normal, t and chi-square laws.

The normal tail is a Column expression, the same formula in SQL. t and chi-square tails run as pandas UDFs over
aggregated rows, by continued fractions in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The public rational approximation of erfc with error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc_sql(z: str) -> str:
    """SQL for erfc(z), z >= 0."""
    t = f"(1 / (1 + 0.5 * ({z})))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-({z}) * ({z}) + {poly}))"


def two_sided_sql(z: str) -> str:
    """SQL for the two-sided normal p of z."""
    return f"least(1.0, {erfc_sql(f'abs({z}) / sqrt(2.0)')})"


def t_two_sided_sql(t: str, df: str) -> str:
    """SQL for the two-sided p of t for a whole number of degrees: the finite series in the angle atan(t / sqrt(df))."""
    a, c2 = f"atan(abs({t}) / sqrt({df}))", f"(({df}) / (({df}) + ({t}) * ({t})))"
    even = f"sin({a}) * list_sum(list_transform(range(({df}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow({c2}, k)))"
    odd = f"2 / pi() * ({a} + sin({a}) * cos({a}) * coalesce(list_sum(list_transform(range((({df}) - 1) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow({c2}, k))), 0))"
    return f"(1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def chi2_upper_sql(x: str, df: str) -> str:
    """SQL for the upper chi-square tail for an even number of degrees."""
    return f"(exp(-({x}) / 2) * list_sum(list_transform(range(({df}) // 2), lambda k: pow(({x}) / 2, k) / exp(lgamma(k + 1)))))"


def two_sided(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or 1e-30)
        c = (1 + n / c) or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_part(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """t with P(T <= t) = p, for p above one half."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of the chi-square law, by series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t; NULL where t or df is NULL or df is not positive."""
    return pd.Series([None if not (np.isfinite(a) and b > 0) else t_two_sided(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if not (np.isfinite(a) and b > 0) else chi2_upper(a, b) for a, b in zip(x.astype(float), df.astype(float), strict=True)], dtype="float64")
