"""Statistical functions as column expressions, and the ones that need a log-gamma as vectorised functions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The published coefficients of the rational approximation to the inverse normal (P. J. Acklam).
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
PPF_LOW = 0.02425


def norm_cdf(x: Column) -> Column:
    """By the series of positive terms x, x^3/3, x^5/15, ...; beyond 8 deviations it is 0 or 1."""
    a = F.least(F.abs(x), F.lit(8.0))
    acc = F.struct(a.alias("t"), a.alias("s"))
    step = lambda s, k: F.struct((s["t"] * a * a / (2 * k + 1)).alias("t"), (s["s"] + s["t"] * a * a / (2 * k + 1)).alias("s"))
    half = F.aggregate(F.sequence(F.lit(1), F.lit(200)), acc, step)["s"] * F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    return F.lit(0.5) + F.signum(x) * F.least(half, F.lit(0.5))


def _poly(coefficients: list[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_ppf(p: Column) -> Column:
    """Inverse normal; minus and plus infinity at 0 and 1 and beyond."""
    tail = lambda q: _poly(PPF_C, q) / _poly([*PPF_D, 1.0], q)
    low = tail(F.sqrt(-2 * F.log(F.when(p > 0, p))))
    high = -tail(F.sqrt(-2 * F.log(F.when(p < 1, 1 - p))))
    r = (p - 0.5) * (p - 0.5)
    middle = _poly(PPF_A, r) * (p - 0.5) / _poly([*PPF_B, 1.0], r)
    return F.when(p <= 0, F.lit(-math.inf)).when(p >= 1, F.lit(math.inf)).when(p < PPF_LOW, low).when(p > 1 - PPF_LOW, high).otherwise(middle)


#: Discordant pairs up to which binomial terms are summed as they are: their largest sum still is a double.
EXACT_PAIRS = 1000


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts.

    Up to EXACT_PAIRS the terms are built from 1 by their ratios and scaled once, so small counts are exact; beyond,
    the same tail is an incomplete beta function, so no row holds as many terms as there are pairs.
    """
    n, k = b + c, F.least(b, c)
    acc = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(s: Column, i: Column) -> Column:
        t = s["t"] * (n - i + 1) / i
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    some = F.when((k > 0) & (n <= EXACT_PAIRS), F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    exact = F.aggregate(some, acc, step)["s"] * F.pow(F.lit(2.0), 1 - n.cast("double"))
    tail = F.when(n <= EXACT_PAIRS, exact).otherwise(2 * half_tail(n.cast("double"), k.cast("double")))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), tail))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null, unlike with greatest and least alone."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def cohens_h(p: Column, q: Column) -> Column:
    angle = lambda x: 2 * F.asin(F.sqrt(clamp(x, 0.0, 1.0)))
    return F.abs(angle(p) - angle(q))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its hypergeometric series, from the nearer end."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    term = total = 1.0
    n = 0
    while term > total * 1e-17:
        term *= x * (a + b + n) / (a + 1 + n)
        total += term
        n += 1
    return total * math.exp(math.lgamma(a + b) - math.lgamma(a + 1) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))


@F.pandas_udf(DoubleType())
def f_survival(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """P(F > f) of each row; a row a cell, so the volume is small."""
    return pd.Series([math.nan if not f0 >= 0 else beta_share(n / 2, m / 2, n / (n + m * f0)) for f0, n, m in zip(f, d2, d1, strict=True)])


@F.pandas_udf(DoubleType())
def half_tail(n: pd.Series, k: pd.Series) -> pd.Series:
    """P(X <= k) of n fair draws, for n over EXACT_PAIRS."""
    return pd.Series([beta_share(m - i, i + 1, 0.5) if m > EXACT_PAIRS else math.nan for m, i in zip(n, k, strict=True)])
