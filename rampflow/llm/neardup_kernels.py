"""Pure NumPy kernels of the near-duplicate operator: shingle hashes, fast similarity sketch, bands."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_U = np.uint64
#: Odd multipliers of the positions in a shingle, and the steps of the 64-bit finaliser (splitmix64).
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def words(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased; other letters stay as they are."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` make one shingle."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)))
    k = min(width, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix((acc + _STEP) ^ h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def set_key(s: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(s: np.ndarray, t: int = 256) -> np.ndarray:
    """Fast similarity sketch of a non-empty set.

    In round i < t every element falls into a bin by hash and leaves a value; a bin keeps the least
    value of the first round that reaches it. Rounds t..2t-1 send every element to bin i - t, so all
    bins fill after 2t rounds at most; about ``t log t / len(s)`` rounds are expected.
    """
    out, empty = np.zeros(t, np.uint64), np.ones(t, bool)
    at, n, seeds = 0, len(s), np.arange(1, 2 * t + 1, dtype=np.uint64) * _STEP
    while at < t and empty.any():
        r = int(min(t - at, max(1, 3000 // n)))
        v = mix(s[None, :] + seeds[at : at + r, None])
        grid = np.full(r * t, FULL, np.uint64)
        where = (v >> _U(40)).astype(np.int64) % t + np.arange(r)[:, None] * t
        np.minimum.at(grid, where.ravel(), mix(v).ravel())
        grid = grid.reshape(r, t)
        hit = grid != FULL
        first = hit.argmax(0)
        fill = empty & hit.any(0)
        out[fill] = grid[first[fill], np.flatnonzero(fill)]
        empty &= ~fill
        at += r
    for b in np.flatnonzero(empty):
        out[b] = mix(mix(s + seeds[t + b])).min()
    return out


def bands(sk: np.ndarray, n_bands: int = 32, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each band of the sketch's first coordinates; the band's number is part of the key."""
    grid = sk[: n_bands * rows].reshape(n_bands, rows)
    acc = mix(np.arange(1, n_bands + 1, dtype=np.uint64) * _STEP)
    for j in range(rows):
        acc = mix((acc + _STEP) ^ grid[:, j])
    return acc.view(np.int64)


def compact(sk: np.ndarray) -> bytes:
    """The low four bits of each coordinate, two to a byte; a coordinate of other sets agrees by chance once in 16."""
    low = (sk & _U(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates in which rows of ``a`` and ``b`` (compact sketches as uint8, broadcast) agree."""
    x = np.bitwise_xor(a, b)
    return (((x & 15) == 0).sum(-1) + ((x >> 4) == 0).sum(-1)).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted distinct hashes are similar enough."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum()) if len(large) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def least_agreeing(t: int, percent: int, sigmas: float = 6.0) -> float:
    """A pair at the linking threshold agrees less often than this with probability below 1e-9."""
    p = percent / 100 + (1 - percent / 100) / 16
    return t * p - sigmas * (t * p * (1 - p)) ** 0.5
