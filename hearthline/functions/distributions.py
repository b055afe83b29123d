"""Tails of distributions, as plain numbers for the few statistics of a fit."""

from __future__ import annotations

import math


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_sf(x: float, df: int) -> float:
    """Each two degrees add one term to the tail of one or two degrees."""
    if x <= 0:
        return 1.0
    half = x / 2
    tail, k = (math.erfc(math.sqrt(half)), 1) if df % 2 else (math.exp(-half), 2)
    while k < df:
        tail += math.exp(k / 2 * math.log(half) - half - math.lgamma(k / 2 + 1))
        k += 2
    return min(tail, 1.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_critical(df: float, level: float = 0.95) -> float:
    """The bound that |t| stays below with probability `level`, by bisection."""
    low, high = 0.0, 1.0
    while t_p(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2
