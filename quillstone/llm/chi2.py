"""The chi-square distribution function and its inverse."""

from __future__ import annotations

import math


def cdf(x: float, k: int) -> float:
    """P(X <= x) for k degrees of freedom: the regularised lower incomplete gamma function as a series."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    if y > a + 60 + 12 * math.sqrt(a):
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def quantile(p: float, k: int) -> float:
    """The x with cdf(x, k) = p, by bisection."""
    low, high = 0.0, 1.0
    while cdf(high, k) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid, k) < p else (low, mid)
    return (low + high) / 2
