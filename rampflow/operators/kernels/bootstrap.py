"""Resampling inference for one small sample."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ...functions.dist import normal_cdf, normal_ppf
from .slopes import Median, above_both, above_equal

#: Drawn values that are held at once.
HELD = 1 << 20
#: Largest sample whose pairwise slopes are looked at one by one.
PAIRWISE = 256


def _dz(x: np.ndarray) -> np.ndarray:
    sd = x.std(-1, ddof=1)
    return np.divide(x.mean(-1), sd, out=np.full(x.shape[:-1], np.nan), where=sd != 0)


#: Statistics of the last axis, by name; a caller may add its own.
STATISTICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"mean": lambda x: x.mean(-1), "median": lambda x: np.median(x, -1), "dz": _dz}


def blocks(times: int, n: int) -> list[int]:
    """How many of ``times`` draws of ``n`` values are made at once. Draws one after the other are those of one large matrix."""
    size = max(1, HELD // max(n, 1))
    return [min(size, times - at) for at in range(0, times, size)]


def omitted(x: np.ndarray, statistic: str) -> np.ndarray:
    """The statistic with each value left out: sums without the value, or the places that the median of the others is at."""
    n = len(x)
    if statistic not in ("mean", "median", "dz"):
        return np.array([float(STATISTICS[statistic](np.delete(x, i))) for i in range(n)])
    m, by = n - 1, np.argsort(x, kind="stable")
    v, place = x[by], np.empty(n, np.int64)
    place[by] = np.arange(n)
    if statistic == "median":
        low, high = (m - 1) // 2, m // 2
        return (v[low + (place <= low)] + v[high + (place <= high)]) / 2
    if v[0] == v[-1]:
        return np.full(n, v[0] if statistic == "mean" else np.nan)
    c = x - x.mean()
    rest = c.sum() - c
    mean, own, whole = x.mean() + rest / m, c * c, float(c @ c)
    square = whole - own - rest * rest / m
    alone = np.flatnonzero(square <= 0.01 * whole)  # one value is nearly all of the spread: what is left is summed anew
    if statistic == "mean":
        mean[alone] = [np.delete(x, i).mean() for i in alone]
        return mean
    spread = np.sqrt(np.maximum(square, 0.0) / (m - 1))
    out = np.divide(mean, spread, out=np.full(n, np.nan), where=spread > 0)
    out[alone] = [_dz(np.delete(x, i)) for i in alone]
    out[v[np.where(place == 0, 1, 0)] == v[np.where(place == m, m - 1, m)]] = np.nan
    return out


def interval(estimate: float, found: np.ndarray, knife: np.ndarray, level: float, tie: float = 0.0) -> tuple[float, float]:
    found = found[np.isfinite(found)]
    below = (found < estimate - tie).sum() + 0.5 * (np.abs(found - estimate) <= tie).sum()
    edge = 0.5 / len(found)
    z0 = normal_ppf(min(max(below / len(found), edge), 1 - edge))
    pull = knife.mean() - knife
    spread = 6 * (pull**2).sum() ** 1.5
    a = (pull**3).sum() / spread if np.isfinite(knife).all() and spread > 0 else 0.0
    ends = []
    for p in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal_ppf(p)
        ends.append(min(max(normal_cdf(z0 + z / (1 - a * z)), 0.0), 1.0))
    lo, hi = np.quantile(found, ends)
    return float(lo), float(hi)


def bca(x: np.ndarray, statistic: str = "mean", times: int = 10_000, seed=20260805, level: float = 0.95, tie_eps: float = 0.0) -> tuple[float, float, float]:
    """(estimate, low, high) of a bias-corrected accelerated bootstrap; NaN ends under three finite values.

    ``tie_eps`` counts replicates within so many rounding units of the estimate as equal to it.
    """
    f = STATISTICS[statistic]
    x = x[np.isfinite(x)]
    if not len(x):
        return math.nan, math.nan, math.nan
    estimate = float(f(x)) if len(x) > 1 or statistic != "dz" else math.nan
    if len(x) < 3:
        return estimate, math.nan, math.nan
    rng = np.random.default_rng(seed)
    found = np.concatenate([f(x[rng.integers(0, len(x), (k, len(x)))]) for k in blocks(times, len(x))])
    if np.isfinite(found).sum() < max(100, times // 2):
        return estimate, math.nan, math.nan
    knife = omitted(x, statistic)
    tie = tie_eps * np.finfo(float).eps * max(1.0, float(np.abs(x).max()))
    return estimate, *interval(estimate, found, knife, level, tie)


def correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's r along the last axis; NaN where a side is constant."""
    a, b = x - x.mean(-1, keepdims=True), y - y.mean(-1, keepdims=True)
    s = np.sqrt((a * a).sum(-1) * (b * b).sum(-1))
    return np.divide((a * b).sum(-1), s, out=np.full(s.shape, np.nan), where=s > 0)


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def places(x: np.ndarray) -> tuple[int, np.ndarray]:
    """How many different values there are, and each one's place among them."""
    values, place = np.unique(x, return_inverse=True)
    return len(values), place


def resampled_ranks(x: np.ndarray | tuple[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Average ranks of each row of ``x[at]``, by counting: the order of x, or its ``places``, is found once for all rows."""
    many, place = x if isinstance(x, tuple) else places(x)
    out = np.empty(at.shape)
    for i, row in enumerate(place[at]):
        n = np.bincount(row, minlength=many)
        out[i] = (np.cumsum(n) - (n - 1) / 2)[row]
    return out


def permuted(rng: np.random.Generator, n: int) -> np.ndarray:
    """``np.argsort(rng.random(n))``, by sorting whole numbers that hold a draw's upper bits and its place."""
    drawn = rng.integers(0, 1 << 64, n, np.uint64)
    mask = np.uint64((1 << max(n - 1, 1).bit_length()) - 1)
    held = (drawn & ~mask) | np.arange(n, dtype=np.uint64)
    held.sort()
    if ((held[1:] ^ held[:-1]) <= mask).any():  # equal as far as their upper bits go
        return np.argsort((drawn >> np.uint64(11)) * 2.0**-53)
    return (held & mask).view(np.int64)


def as_far(a: np.ndarray, b: np.ndarray, count: int, rng: np.random.Generator) -> int:
    """Of ``count`` permutations of ``b`` how many correlate with ``a`` as far from 0 as it does."""
    known = abs(float(correlation(a, b))) - 1e-15
    x, y, far = a - a.mean(), b - b.mean(), 0
    size = math.sqrt(float(x @ x) * float(y @ y))
    for _ in range(count):
        by = permuted(rng, len(b))
        over = abs(float(x @ y[by])) / size - known
        # So near that the order of a sum decides.
        far += bool(abs(correlation(a, b[by])) >= known) if abs(over) < 1e-10 else over > 0
    return far


def omitted_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's r with each pair left out, from sums without it; NaN where a side of the others is constant."""
    n = len(x)
    if n < 3 or x.min() == x.max() or y.min() == y.max():
        return np.full(n, np.nan)
    a, b = x - x.mean(), y - y.mean()
    sums = [v.sum() - v for v in (a, b, a * a, b * b, a * b)]
    xx, yy, xy = sums[2] - sums[0] ** 2 / (n - 1), sums[3] - sums[1] ** 2 / (n - 1), sums[4] - sums[0] * sums[1] / (n - 1)
    out = np.divide(xy, np.sqrt(np.maximum(xx, 0.0) * np.maximum(yy, 0.0)), out=np.full(n, np.nan), where=(xx > 0) & (yy > 0))
    for i in np.flatnonzero((xx <= 0.01 * float(a @ a)) | (yy <= 0.01 * float(b @ b))):  # one pair is nearly all of a side's spread
        out[i] = _correlation(np.delete(x, i), np.delete(y, i))
    return out


def omitted_spearman(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman's rho with each pair left out. Without a pair, ranks above its own fall by 1 and ranks equal to it by a half, so that the
    sums of ranks of the others follow from sums over larger and equal values; all of it in whole numbers (quarters)."""
    n = len(x)
    if n < 3:
        return np.full(n, np.nan)
    r, s = (np.rint(2 * ranks(v)).astype(np.int64) for v in (x, y))

    def over(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ``w`` over values above each, and over those equal to it (itself included)."""
        _, at = np.unique(v, return_inverse=True)
        # Whole sums in halves: exact below 2**53, which is past n = 90 million.
        own = np.bincount(at, weights=w)
        return (own[::-1].cumsum()[::-1] - own)[at].astype(np.int64), own[at].astype(np.int64)

    one = np.ones(n, np.int64)
    (sx, ex), (sy, ey) = over(r, s), over(s, r)
    (more_x, same_x), (more_y, same_y) = over(r, one), over(s, one)
    # Pairs above in both, above in x and equal in y, equal in x and above in y, equal in both.
    gg = above_both(r, s)
    _, cell, size = np.unique(r * (2 * n + 1) + s, return_inverse=True, return_counts=True)
    ee = size[cell]
    ge, eg = above_equal(r, s), above_equal(s, r)
    # Four times the sum of products of the others' ranks: (r - 2 above - equal) (s - 2 above - equal), less the pair's own.
    total = int((r * s).sum())
    cross = total - (2 * sx + ex) - (2 * sy + ey) + 4 * gg + 2 * ge + 2 * eg + ee - (r - 1) * (s - 1)

    def square(r: np.ndarray, above: tuple[np.ndarray, np.ndarray], more: np.ndarray, same: np.ndarray) -> np.ndarray:
        return int((r * r).sum()) - 2 * (2 * above[0] + above[1]) + 4 * more + same - (r - 1) ** 2

    xx, yy = square(r, over(r, r), more_x, same_x), square(s, over(s, s), more_y, same_y)
    m = n - 1
    level = m * (m + 1) * (m + 1)  # four times m squared mean ranks
    xx, yy, xy = xx - level, yy - level, cross - level
    return np.divide(xy, np.sqrt(xx.astype(float)) * np.sqrt(yy.astype(float)), out=np.full(n, np.nan), where=(xx > 0) & (yy > 0))


def _correlation(x: np.ndarray, y: np.ndarray) -> float:
    """As correlation, and NaN for a constant side whatever its mean rounds to."""
    return float(correlation(x, y)) if x.min() < x.max() and y.min() < y.max() else math.nan


def _slopes(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Median pairwise slope of each row; NaN where all x are equal."""
    out = np.full(len(at), np.nan)
    if at.shape[1] > PAIRWISE:
        found = Median()
        for i, row in enumerate(at):
            out[i] = found(x[row], y[row])[1]
        return out
    i, j = np.triu_indices(at.shape[1], 1)
    lo = 0
    for k in blocks(len(at), len(i)):
        a, b = x[at[lo : lo + k]], y[at[lo : lo + k]]
        dx, part = a[:, j] - a[:, i], np.full(k, np.nan)
        slope = np.divide(b[:, j] - b[:, i], dx, out=np.full(dx.shape, np.nan), where=dx != 0)
        some = (dx != 0).any(-1)
        part[some] = np.nanmedian(slope[some], -1)
        out[lo : lo + k] = part
        lo += k
    return out


#: Statistics of the pairs (x, y) at each row of places, by name.
PAIRED: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]] = {
    "pearson": lambda x, y, at: correlation(x[at], y[at]),
    "spearman": lambda x, y, at: correlation(resampled_ranks(x, at), resampled_ranks(y, at)),
    "theil_sen": _slopes,
}
#: The same with each pair left out.
OMITTED: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"pearson": omitted_correlation, "spearman": omitted_spearman}
