"""Tail probabilities and quantiles, in plain Python."""

from __future__ import annotations

import math


def normal_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """For one or two degrees of freedom."""
    if df == 1:
        return math.erfc(math.sqrt(max(0.0, x) / 2))
    if df == 2:
        return math.exp(-x / 2)
    raise ValueError("one or two degrees of freedom")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_sf(x: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return half if x >= 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    """Quantile by bisection."""
    if p < 0.5:
        return -t_ppf(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_sf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def sign_pvalue(positive: int, negative: int) -> float:
    """Two-sided exact binomial test at one half."""
    n, k = positive + negative, min(positive, negative)
    if not n:
        return math.nan
    log_half = n * math.log(0.5)
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + log_half) for i in range(k + 1))
    return min(1.0, 2 * tail)


def mde(n_origins: float, design_effect: float = 1.0, alpha: float = 0.05, power: float = 0.8) -> float:
    """Minimum detectable effect in standard deviations."""
    if n_origins <= 0 or design_effect <= 0:
        raise ValueError("n_origins and design_effect must be positive")
    n = n_origins / design_effect
    df = max(2, math.floor(n - 1))
    return (t_ppf(1 - alpha / 2, df) + t_ppf(power, df)) / math.sqrt(n)
