"""Distribution functions without SciPy: normal, gamma, beta and their relatives, and exact rank tests."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_N = NormalDist()
normal_cdf = _N.cdf


def normal_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _N.inv_cdf(p)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_ppf(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
        if hi - lo <= 1e-16 * max(hi, 1e-300):
            break
    return (lo + hi) / 2


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def t_ppf(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    x = beta_ppf(2 * min(p, 1 - p), df / 2, 0.5)
    t = math.sqrt(df * (1 - x) / x)
    return t if p > 0.5 else -t


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(d2 / (d2 + d1 * x), d2 / 2, d1 / 2)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    if n <= 0:
        return math.nan, math.nan
    a = (1 - level) / 2
    return (0.0 if k == 0 else beta_ppf(a, k, n - k + 1)), (1.0 if k == n else beta_ppf(1 - a, k + 1, n - k))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n trials of chance one half."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    if n <= 1_000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    # The largest term by logarithms, the smaller ones by their ratios until none adds anything: about the root of n terms.
    term = tail = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    for i in range(k, 0, -1):
        term *= i / (n - i + 1)
        tail += term
        if term <= tail * 1e-18:
            break
    return min(1.0, 2 * tail)


def signed_rank(d: np.ndarray) -> tuple[float, float, str]:
    """Wilcoxon's W, two-sided p and how it was found: exact without zeros and ties (n <= 50), else normal.

    Zeros are dropped and ties get average ranks; there is no continuity correction.
    """
    d = d[np.isfinite(d)]
    if not len(d):
        return math.nan, math.nan, "not_estimable"
    if not d.any():
        return 0.0, 1.0, "all_zero"
    x = d[d != 0]
    size, count = np.unique(np.abs(x), return_inverse=True, return_counts=True)[1:]
    rank = (np.cumsum(count) - (count - 1) / 2)[size]
    n = len(x)
    up = float(rank[x > 0].sum())
    w = min(up, n * (n + 1) / 2 - up)
    if n == len(d) and (count == 1).all() and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n), "exact"
    spread = n * (n + 1) * (2 * n + 1) / 24 - float((count**3 - count).sum()) / 48
    return w, min(1.0, 2 * normal_cdf((w - n * (n + 1) / 4) / math.sqrt(spread))), "normal"
