"""The median of all pairwise slopes without looking at all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Most pairs that are looked at one by one because many points are equal.
MOST = 4_000_000
#: So few pairs of points are all looked at for every resample.
EVERY = 1 << 20
#: Bytes of weights of resamples that are found together.
WEIGHTS = 1 << 28


def _merged(rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Halves of blocks of doubling length, sorted: all ``left`` ranks, all ``right`` ranks, and for each right one the range of left ones, from
    ``start`` to ``end``, that are before it in ``rank`` and above it."""
    n, size, held = len(rank), 1, rank
    at = np.arange(n)
    while size < n:
        block = at // (2 * size)
        first = at % (2 * size) < size
        value = held + block * n
        left, right = value[first], value[~first]
        start = np.searchsorted(left, right)
        yield held[first], held[~first], start, (block[~first] + 1) * size
        place = np.zeros(n, bool)
        place[start + np.arange(len(right))] = True
        held = np.empty(n, rank.dtype)
        held[place], held[~place] = right - block[~first] * n, left - block[first] * n
        size *= 2


def _order(z: np.ndarray) -> np.ndarray:
    """Places from 0 in ascending order; equal values in their own order."""
    out = np.empty(len(z), np.int64)
    out[np.argsort(z, kind="stable")] = np.arange(len(z))
    return out


def _weighed(rank: np.ndarray, weight: np.ndarray | None = None) -> int:
    """Pairs i < j with rank[j] < rank[i], each as often as the product of its weights, which are whole."""
    total = 0
    by_rank = None
    if weight is not None:
        by_rank = np.empty(len(rank), np.int64)
        by_rank[rank] = weight
    for left, right, start, end in _merged(rank):
        if by_rank is None:
            total += int((end - start).sum())
        else:
            sums = np.concatenate(([0], np.cumsum(by_rank[left])))
            total += int(((sums[end] - sums[start]) * by_rank[right]).sum())
    return total


def inversions(z: np.ndarray) -> int:
    """Pairs i < j with z[j] < z[i], by ranks and merging halves of doubling length."""
    return _weighed(_order(z))  # equal values in order are no inversion


def above_both(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each pair of whole numbers (r, s) how many are above it in both."""
    by = np.lexsort((s, -r))  # what is above in r comes before; equal r in ascending order of s
    rank = _order(s[by])
    found = np.zeros(len(r), np.int64)
    for _, right, start, end in _merged(rank):
        found[right] += end - start
    out = np.empty(len(r), np.int64)
    out[by] = found[rank]
    return out


def above_equal(r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """For each pair of whole numbers from 0 on how many are above it in r and equal to it in s."""
    span = int(r.max()) + 1
    key = s * span + r
    held = np.sort(key)
    return np.searchsorted(held, (s + 1) * span) - np.searchsorted(held, key, "right")


def _between(x: np.ndarray, y: np.ndarray, lo: float, hi: float, most: int | None = None) -> np.ndarray | None:
    """Pairs (as rows of two places) of slopes that are not below ``lo`` and below ``hi``: those that change places between the two orders of intercepts.
    None if they are more than ``most``."""
    first = np.argsort(y - lo * x, kind="stable")
    later = _order(y - hi * x)
    rank = later[first]
    who = np.empty(len(x), np.int64)
    who[later] = np.arange(len(x))
    out, held = [], 0
    for left, right, start, end in _merged(rank):
        many = end - start
        held += int(many.sum())
        if most is not None and held > most:
            return None
        pairs = np.empty((int(many.sum()), 2), np.int64)
        pairs[:, 0] = who[left[np.arange(len(pairs)) + np.repeat(start - (np.cumsum(many) - many), many)]]
        pairs[:, 1] = who[np.repeat(right, many)]
        out.append(pairs)
    out = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    return out[x[out[:, 0]] != x[out[:, 1]]]


class Median:
    """(pairs of different x, median of their slopes) of points; NaN without a pair.

    The number of slopes below a value s is the number of inversions of y - s x in the order of x. Equal points are one with a weight. A
    guess of the median and of the slopes a unit there, at first from some pairs, then from what the last points gave, sets the
    values that are tried; if they don't hold the median between them bisection goes on until few pairs are left, and these are
    looked at one by one: n log n a step, and pairs of about 8 n at the end. The guess is no part of the result, so that resamples of
    the same points are found in few steps each.
    """

    def __init__(self):
        self.guess: float | None = None
        self.pace = 0.0

    def __call__(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
        keep = np.isfinite(x) & np.isfinite(y)
        by = np.lexsort((y[keep], x[keep]))
        x, y = x[keep][by], y[keep][by]
        n = len(x)
        _, same = np.unique(x, return_counts=True)
        total = n * (n - 1) // 2 - int((same * (same - 1) // 2).sum())
        if not total:
            return 0, math.nan
        new = np.concatenate(([True], (np.diff(x) != 0) | (np.diff(y) != 0)))
        weight = np.diff(np.append(np.flatnonzero(new), n))
        x, y = x[new], y[new]
        self._points = x, y, weight, None if (weight == 1).all() else weight
        gaps = np.diff(x)
        span = 1.01 * float((y.max() - y.min()) / gaps[gaps > 0].min()) + 1e-300
        want = (total - 1) // 2, total // 2
        room = max(8 * n, min(8 * n * n // len(x), MOST), 64)
        lo, hi, n_lo, n_hi = self._narrowed(want, -span, span, total, room)
        if n_hi - n_lo > room:  # a value that many pairs share is one of the medians or both
            found = [self._place(w, lo, hi, n_lo, n_hi, room) for w in dict.fromkeys(want)]
        else:
            found = self._held(want, lo, hi, n_lo)
        median = found[0] if len(found) == 1 else (found[0] + found[1]) / 2
        self.guess = median
        return total, float(median)

    def _below(self, s: float) -> int:
        x, y, _, weight = self._points
        z = y - s * x
        by = np.lexsort((z, x))  # equal x in the order of z, so that they are never inverted
        return _weighed(_order(z[by]), None if weight is None else weight[by])

    def _narrowed(self, want, lo: float, hi: float, total: int, room: int) -> tuple[float, float, int, int]:
        """Two values with few slopes between them that hold the medians, if guesses lead there; else what is known of them."""
        n_lo, n_hi = 0, total
        if n_hi <= room:
            return lo, hi, n_lo, n_hi
        if self.guess is None:
            self._sampled(total)
        s = self.guess

        def tried(s: float) -> int:
            nonlocal lo, hi, n_lo, n_hi
            if not lo < s < hi:
                return n_lo if s <= lo else n_hi
            k = self._below(s)
            if k <= want[0]:
                lo, n_lo = s, k
            elif k > want[-1]:
                hi, n_hi = s, k
            return k

        for _ in range(6):
            if n_hi - n_lo <= room or not self.pace > 0:
                break
            k = tried(s)
            aim = s + ((want[0] + want[-1]) / 2 - k) / self.pace
            at = aim - 0.4 * room / self.pace, aim + 0.4 * room / self.pace
            a, b = (tried(v) for v in at)
            if b > a and at[1] > at[0]:
                self.pace = (b - a) / (at[1] - at[0])
            s = aim
        return lo, hi, n_lo, n_hi

    def _sampled(self, total: int) -> None:
        """A guess from pairs at some distances in the order of x."""
        x, y, _, _ = self._points
        n = len(x)
        steps = np.unique(np.linspace(1, n - 1, 64).astype(np.int64))
        i = np.concatenate([np.arange(0, n - h, max(1, n // 512)) for h in steps])
        h = np.concatenate([np.full(len(range(0, n - h, max(1, n // 512))), h) for h in steps])
        dx = x[i + h] - x[i]
        slope = (y[i + h] - y[i])[dx > 0] / dx[dx > 0]
        self.guess = 0.0
        if len(slope):
            a, self.guess, b = (float(v) for v in np.quantile(slope, (0.45, 0.5, 0.55)))
            self.pace = 0.1 * total / (b - a) if b > a else 0.0

    def _held(self, want, lo: float, hi: float, n_lo: int) -> list[float]:
        x, y, weight, _ = self._points
        pairs = _between(x, y, lo, hi)
        i, j = pairs[:, 0], pairs[:, 1]
        slope = (y[i] - y[j]) / (x[i] - x[j])
        by = np.argsort(slope)
        upto = n_lo + np.cumsum((weight[i] * weight[j])[by])
        return [float(slope[by[min(int(np.searchsorted(upto, w, "right")), len(by) - 1)]]) for w in dict.fromkeys(want)]

    def _place(self, want: int, lo: float, hi: float, n_lo: int, n_hi: int, room: int) -> float:
        while n_hi - n_lo > room:
            middle = lo + (hi - lo) / 2
            if not lo < middle < hi:
                return middle  # a value that many pairs share
            k = self._below(middle)
            lo, hi, n_lo, n_hi = (middle, hi, k, n_hi) if k <= want else (lo, middle, n_lo, k)
        return self._held((want,), lo, hi, n_lo)[0]


def median_slope(x: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """(pairs of different x, median of their slopes); NaN without a pair."""
    return Median()(x, y)


class Resampled:
    """Median slopes of many resamples of the same points; a resample is a weight a point.

    The points of a resample have the order of all points, so that the slopes below one value are counted for many resamples in one merge. How
    many each point has a share in, of all points, tells to about n pairs where a resample's median will be; resamples of near medians
    share two values around them and the pairs between these. What is not held between its values is found alone, by ``Median``.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        fine = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        by = fine[np.lexsort((y[fine], x[fine]))]
        new = np.diff(x[by], prepend=np.nan) != 0
        self.level = np.flatnonzero(new)  # starts of equal x, until equal points are one
        new |= np.diff(y[by], prepend=np.nan) != 0
        number = np.cumsum(new) - 1
        self.level = number[self.level]
        self.x, self.y = x[by[new]], y[by[new]]
        self.which = np.full(len(x), len(self.x), np.int64)
        self.which[by] = number
        self.alone = Median()

    def weights(self, row: np.ndarray) -> np.ndarray:
        w = np.bincount(self.which[row], minlength=len(self.x) + 1)[: len(self.x)]
        return w.astype(np.uint16 if w.max(initial=0) < 1 << 16 else np.int64)

    def __call__(self, draws: Iterator[np.ndarray]) -> np.ndarray:
        """The medians of the rows of places in ``draws``; NaN where all x are equal."""
        out, held = [], []
        for rows in draws:
            for row in rows:
                held.append(self.weights(row))
                if len(held) * held[-1].nbytes > WEIGHTS:
                    out.append(self.medians(held))
                    held = []
        return np.concatenate([*out, self.medians(held)])

    def medians(self, weights: list[np.ndarray]) -> np.ndarray:
        out, wants = np.full(len(weights), np.nan), {}
        for k, w in enumerate(weights):
            n, same = int(w.sum(dtype=np.int64)), np.add.reduceat(w, self.level, dtype=np.int64) if len(w) else w
            if total := n * (n - 1) // 2 - int((same * (same - 1) // 2).sum()):
                wants[k] = (total - 1) // 2, total // 2
        u = len(self.x)
        if u * (u - 1) // 2 <= EVERY:
            i, j = np.triu_indices(u, 1)
            some = self.x[i] != self.x[j]
            self._held(i[some], j[some], dict.fromkeys(wants, 0), weights, wants, out)
        else:
            self._grouped(weights, wants, out)
        for k in wants:
            if math.isnan(out[k]):
                out[k] = self.alone(np.repeat(self.x, weights[k]), np.repeat(self.y, weights[k]))[1]
        return out

    def _grouped(self, weights: list[np.ndarray], wants: dict[int, tuple[int, int]], out: np.ndarray) -> None:
        whole = self.weights(np.arange(len(self.which)))
        n = int(whole.sum(dtype=np.int64))
        _, middle = self.alone(np.repeat(self.x, whole), np.repeat(self.y, whole))
        pace = self.alone.pace
        if not (pace > 0 and math.isfinite(pace)) or not wants:
            return
        (base,) = self._below(middle, [whole])
        share = self._shares(middle, whole)
        off = {k: (a + b) / 2 - (float(weights[k] @ share) - base) for k, (a, b) in wants.items()}
        span = max(map(abs, off.values())) + 4 * n
        ends = [-span / pace, span / pace]
        for i, side in enumerate((-1, 1)):  # how far from the median the span's slopes are
            for _ in range(40):
                found = side * (self._below(middle + ends[i], [whole])[0] - base)
                if span <= found <= 2 * span:
                    break
                ends[i] *= 1.3 * span / found if found > 0.05 * span else 8
            else:
                return
        at = middle + np.concatenate((np.linspace(ends[0], 0, 5), np.linspace(0, ends[1], 5)[1:]))
        count = np.array([self._below(s, [whole])[0] - base for s in at], float)
        by = sorted(off, key=off.get)
        while by:
            some = [k for k in by if off[k] <= off[by[0]] + 8 * n]
            by = by[len(some) :]
            lo, hi = (float(v) for v in np.interp([off[some[0]] - 2 * n, off[some[-1]] + 2 * n], count, at))
            pairs = _between(self.x, self.y, lo, hi, 48 * n)
            if pairs is not None:
                self._held(*pairs.T, dict(zip(some, self._below(lo, [weights[k] for k in some]), strict=True)), weights, wants, out)

    def _levels(self, s: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``_merged`` for slopes below ``s``, with points in the place of ranks."""
        z = self.y - s * self.x
        by = np.lexsort((z, self.x))
        rank = _order(z[by])
        point = np.empty(len(by), np.int64)
        point[rank] = by
        for left, right, start, end in _merged(rank):
            yield point[left], point[right], start, end

    def _below(self, s: float, weights: list[np.ndarray]) -> list[int]:
        """As often as the weights say, the slopes below ``s``."""
        total = [0] * len(weights)
        for left, right, start, end in self._levels(s):
            sums = np.zeros(len(left) + 1, np.int64)
            for k, w in enumerate(weights):
                np.cumsum(w[left], out=sums[1:])
                total[k] += int(((sums[end] - sums[start]) * w[right]).sum())
        return total

    def _shares(self, s: float, w: np.ndarray) -> np.ndarray:
        """For each point the weight of those with which it makes a slope below ``s``."""
        out = np.zeros(len(self.x))
        for left, right, start, end in self._levels(s):
            sums = np.concatenate(([0], np.cumsum(w[left], dtype=np.int64)))
            out[right] += sums[end] - sums[start]
            begun, ended = (np.bincount(v, weights=w[right], minlength=len(left) + 1) for v in (start, end))
            out[left] += np.cumsum(begun - ended)[:-1]
        return out

    def _held(self, i: np.ndarray, j: np.ndarray, below: dict[int, int], weights, wants, out) -> None:
        """Medians among the pairs (i, j), after ``below`` slopes."""
        slope = (self.y[i] - self.y[j]) / (self.x[i] - self.x[j])
        by = np.argsort(slope)
        i, j, slope = i[by], j[by], slope[by]
        for k, first in below.items():
            upto = np.cumsum(weights[k][i].astype(np.int64) * weights[k][j])
            low, high = (w - first for w in wants[k])
            if 0 <= low and len(upto) and high < upto[-1]:
                a, b = slope[np.searchsorted(upto, (low, high), "right")]
                out[k] = a if a == b else (a + b) / 2
