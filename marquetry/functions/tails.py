"""Upper tails of the t and F distributions, for rows that are already aggregated."""

from __future__ import annotations

import math


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / (c if abs(c) > tiny else tiny)
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return math.exp(log_front) * total / a


def f_tail(f: float, df1: float, df2: float) -> float:
    if f is None or math.isnan(f) or df1 <= 0 or df2 <= 0:
        return math.nan
    if f == math.inf:
        return 0.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * max(f, 0.0)))


def t_two_sided(t: float, df: float) -> float:
    return math.nan if t is None or math.isnan(t) else f_tail(t * t, 1.0, df)
