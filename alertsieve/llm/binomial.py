"""Exact (Clopper-Pearson) binomial bounds without a statistics library."""

from __future__ import annotations

from math import ceil, exp, lgamma, log, log1p


def cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial count, summed from its largest term."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    mode = min(k, int((n + 1) * p))
    top = (lgamma(n + 1) - lgamma(mode + 1) - lgamma(n - mode + 1) + mode * log(p) + (n - mode) * log1p(-p))
    odds, total, term = p / (1 - p), 1.0, 1.0
    for i in range(mode, 0, -1):  # downwards
        term *= i / ((n - i + 1) * odds)
        total += term
        if term < total * 1e-17:
            break
    term = 1.0
    for i in range(mode + 1, k + 1):  # upwards
        term *= (n - i + 1) * odds / i
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, exp(top) * total)


def upper_bound(k: int, n: int, delta: float) -> float:
    """The largest rate at which ``k`` or fewer of ``n`` still have
    probability ``delta``: exceeds the true rate with probability 1 - delta."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if cdf(k, n, mid) > delta:
            low = mid
        else:
            high = mid
    return high


def rows_needed(rate: float, delta: float) -> int:
    """Fewest rows without any failure that bound a rate by ``rate``."""
    return ceil(log(delta) / log1p(-rate))
