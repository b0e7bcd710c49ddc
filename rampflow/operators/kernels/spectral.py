"""Splines, spectra, coherence, surrogates, filters and peaks of one series."""

from __future__ import annotations

import math

import numpy as np


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray, ends: str = "natural") -> np.ndarray:
    """Interpolating cubic spline with natural or not-a-knot ends, evaluated at ``at``; beyond the ends its last cubic goes on.

    Not-a-knot ends have three unknowns in their end rows. Each is solved for its outermost one, which leaves a
    tridiagonal system, so memory is linear in the series.
    """
    h, n = np.diff(x), len(x)
    a = np.zeros((3, n))
    b = np.zeros(n)
    a[0, 2:], a[1, 1:-1], a[2, :-2] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    b[1:-1] = 6 * np.diff(np.diff(y) / h)
    a[1, 0] = a[1, -1] = 1.0
    if ends == "natural" or n < 4:
        m = _tridiagonal(a, b)
    else:
        # m[0] = ((h0 + h1) m[1] - h0 m[2]) / h1, and likewise at the other end.
        a[1, 1] += h[0] * (h[0] + h[1]) / h[1]
        a[0, 2] -= h[0] * h[0] / h[1]
        a[1, -2] += h[-1] * (h[-1] + h[-2]) / h[-2]
        a[2, -3] -= h[-1] * h[-1] / h[-2]
        m = np.empty(n)
        m[1:-1] = _tridiagonal(a[:, 1:-1], b[1:-1])
        m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
        m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    l, r, k = at - x[i], x[i + 1] - at, h[i]
    return (m[i] * r**3 + m[i + 1] * l**3) / (6 * k) + (y[i] / k - m[i] * k / 6) * r + (y[i + 1] / k - m[i + 1] * k / 6) * l


def _tridiagonal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    upper, mid, lower, x = a[0, 1:].copy(), a[1].copy(), a[2, :-1], b.copy()
    for i in range(1, len(x)):
        f = lower[i - 1] / mid[i - 1]
        mid[i] -= f * upper[i - 1]
        x[i] -= f * x[i - 1]
    x[-1] /= mid[-1]
    for i in range(len(x) - 2, -1, -1):
        x[i] = (x[i] - upper[i] * x[i + 1]) / mid[i]
    return x


def resample(t: np.ndarray, series: list[np.ndarray], rate: float = 4.0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Natural splines on a uniform grid from the first time, the last time excluded; empty under 4 beats or 10 points."""
    if len(t) < 4:
        return np.empty(0), [np.empty(0) for _ in series]
    if (np.diff(t) <= 0).any():
        raise ValueError("times do not ascend")
    grid = np.arange(t[0], t[-1], 1 / rate)
    if len(grid) < 10:
        return np.empty(0), [np.empty(0) for _ in series]
    return grid, [cubic_spline(t, y, grid) for y in series]


def detrend(x: np.ndarray) -> np.ndarray:
    i = np.arange(len(x)) - (len(x) - 1) / 2
    x = x - x.mean()
    return x - i * ((i @ x) / (i @ i)) if len(x) > 1 else x


def _segments(x: np.ndarray, size: int, overlap: int) -> np.ndarray:
    cut = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - overlap]
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return np.fft.rfft((cut - cut.mean(1, keepdims=True)) * w)


def segment_count(n: int, size: int, overlap: int) -> int:
    return 0 if n < size else 1 + (n - size) // (size - overlap)


def cross_spectrum(x: np.ndarray, y: np.ndarray, size: int = 512, overlap: int = 256, rate: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and averaged one-sided cross density: periodic Hann window, segment means removed."""
    a, b = _segments(x, size, overlap), _segments(y, size, overlap)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    p = (a.conj() * b).mean(0) / (rate * (w * w).sum())
    p[1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / rate), p


def check_options(size: int, overlap: int, rate: float, band: tuple[float, float]) -> None:
    """Raise for options that no spectrum can have: overlap of a whole segment, a band beyond half the rate."""
    if rate <= 0 or size <= 1 or not 0 <= overlap < size:
        raise ValueError("rate, segment and overlap do not fit")
    if not 0 <= band[0] <= band[1] <= rate / 2:
        raise ValueError("the band is not within half the rate")


def coherence(x: np.ndarray, y: np.ndarray, size: int = 512, overlap: int = 256, rate: float = 4.0, band: tuple[float, float] = (0.08, 0.12)) -> float:
    """Mean magnitude-squared coherence in a band, ends included, of detrended series; NaN if they are too short."""
    return _coherence(detrend(x), detrend(y), size, overlap, rate, band)


def _coherence(x, y, size, overlap, rate, band) -> float:
    if min(len(x), len(y)) < size:
        return math.nan
    f, xx = cross_spectrum(x, x, size, overlap, rate)
    yy, xy = cross_spectrum(y, y, size, overlap, rate)[1], cross_spectrum(x, y, size, overlap, rate)[1]
    c = np.abs(xy) ** 2 / (xx.real * yy.real + 1e-20)
    m = (f >= band[0]) & (f <= band[1])
    return float(c[m].mean()) if m.any() else math.nan


def band_power(x: np.ndarray, lo: float, hi: float, size: int = 256, overlap: int = 128, rate: float = 4.0) -> float:
    """Trapezoid of the density of the detrended series in a band; NaN if it is short or has under two bins."""
    if len(x) < size:
        return math.nan
    x = detrend(x)
    f, p = cross_spectrum(x, x, size, overlap, rate)
    m = (f >= lo) & (f <= hi)
    return float(np.trapezoid(p.real[m], f[m])) if m.sum() > 1 else math.nan


def phase_surrogate(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A series of the same amplitude spectrum with random phases; mean and Nyquist terms stay."""
    s = np.fft.rfft(x)
    free = slice(1, len(s) - 1 if len(x) % 2 == 0 else len(s))
    turned = s.copy()
    turned[free] = np.abs(s[free]) * np.exp(1j * rng.uniform(0, 2 * np.pi, len(s[free])))
    return np.fft.irfft(turned, n=len(x))


def surrogate_coherence(x: np.ndarray, y: np.ndarray, count: int, rng: np.random.Generator, size: int, overlap: int, rate: float, band: tuple[float, float], block: int = 64) -> np.ndarray:
    """Coherence in the band of ``count`` pairs of phase surrogates, a block of pairs at a time and at the band's frequencies alone.

    Phases are drawn as one pair after the other would draw them, the first series first.
    """
    n, out = len(x), []
    spectra = [np.fft.rfft(v) for v in (x, y)]
    free = slice(1, len(spectra[0]) - (n % 2 == 0))
    f = np.fft.rfftfreq(size, 1 / rate)
    at = np.flatnonzero((f >= band[0]) & (f <= band[1]))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    scale = np.where((at > 0) & ((at < size / 2) | (size % 2 == 1)), 2.0, 1.0) / (rate * (w * w).sum())
    for lo in range(0, count, block):
        turn = rng.uniform(0, 2 * np.pi, (min(block, count - lo), 2, len(spectra[0][free])))
        cut = []
        for k, s in enumerate(spectra):
            turned = np.repeat(s[None], len(turn), 0)
            turned[:, free] = np.abs(s[free]) * np.exp(1j * turn[:, k])
            pieces = np.lib.stride_tricks.sliding_window_view(np.fft.irfft(turned, n=n), size, axis=1)[:, :: size - overlap]
            cut.append(np.fft.rfft((pieces - pieces.mean(2, keepdims=True)) * w)[:, :, at])
        a, b = cut
        xx, yy, xy = ((p.conj() * q).mean(1) * scale for p, q in ((a, a), (b, b), (a, b)))
        out.append((np.abs(xy) ** 2 / (xx.real * yy.real + 1e-20)).mean(1))
    return np.concatenate(out) if out else np.empty(0)


def coherence_test(x: np.ndarray, y: np.ndarray, surrogates: int = 1_000, seed=0, **options) -> tuple[float, float, float, int]:
    """(observed, 95 % point of the nulls, Monte-Carlo p, exceedances); the first series is drawn first."""
    # Segments of 512 with 256 in common at 4 Hz, and the band.
    o = {"size": 512, "overlap": 256, "rate": 4.0, "band": (0.08, 0.12)} | options
    x, y = detrend(x), detrend(y)
    check_options(**o)
    seen = _coherence(x, y, **o)
    if not math.isfinite(seen):
        return math.nan, math.nan, math.nan, 0
    rng = np.random.default_rng(seed)
    if len(x) != len(y):
        raise ValueError("series of different lengths")
    null = surrogate_coherence(x, y, surrogates, rng, **o)
    null = null[np.isfinite(null)]
    hits = int((null >= seen).sum())
    return seen, float(np.quantile(null, 0.95)), (1 + hits) / (1 + len(null)), hits


def coloured_pair(coupled: bool, rng: np.random.Generator, n: int = 1_200, rate: float = 4.0, band: tuple[float, float] = (0.08, 0.12)) -> tuple[np.ndarray, np.ndarray]:
    """Two AR(1) noises, with a common stochastic component in the band if ``coupled``.

    The component is white noise shaped by the squared gain of a fourth-order Butterworth band-pass, that
    is, as filtered forwards and backwards. Fixed values: the noises' weights 0.85 and 0.80, the component's SD
    2.5, of which the second series gets 0.9, 1,200 samples, 4 Hz, 0.08 to 0.12 Hz.
    """
    out = []
    for a in (0.85, 0.80):
        x = rng.normal(size=n)
        for i in range(1, n):
            x[i] += a * x[i - 1]
        out.append(x)
    if coupled:
        f = np.fft.rfftfreq(n, 1 / rate)
        shift = np.divide(f * f - band[0] * band[1], f * (band[1] - band[0]), out=np.full(len(f), np.inf), where=f > 0)
        shared = np.fft.irfft(np.fft.rfft(rng.normal(size=n)) / (1 + shift**8), n=n)
        shared = 2.5 * (shared - shared.mean()) / shared.std()
        out = [out[0] + shared, out[1] + 0.9 * shared]
    return out[0], out[1]


def chebyshev_band(x: np.ndarray, lo: float, hi: float, order: int = 3, ripple: float = 10.0) -> np.ndarray:
    """Causal Chebyshev-I band-pass; lo and hi are fractions of the Nyquist frequency. Demeans first."""
    eps = math.sqrt(10 ** (ripple / 10) - 1)
    mu = math.asinh(1 / eps) / order
    k = np.arange(1, order + 1)
    theta = np.pi * (2 * k - 1) / (2 * order)
    proto = -math.sinh(mu) * np.sin(theta) + 1j * math.cosh(mu) * np.cos(theta)
    gain = np.real(np.prod(-proto)) / (math.sqrt(1 + eps**2) if order % 2 == 0 else 1.0)
    a, b = (4 * math.tan(math.pi * v / 2) for v in (lo, hi))
    width, centre = b - a, math.sqrt(a * b)
    root = np.sqrt((proto * width / 2) ** 2 - centre**2 + 0j)
    poles = np.concatenate((proto * width / 2 + root, proto * width / 2 - root))
    gain *= width**order
    zeros = np.zeros(order)
    zp, zz = (4 + poles) / (4 - poles), np.concatenate(((4 + zeros) / (4 - zeros), -np.ones(order)))
    gain *= np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    num, den = gain * np.real(np.poly(zz)), np.real(np.poly(zp))
    y, x = np.zeros(len(x)), x - x.mean()
    for i in range(len(x)):
        m = min(i + 1, len(num))
        y[i] = num[:m] @ x[i::-1][:m] - den[1:m] @ y[i - 1 :: -1][: m - 1] if i else num[0] * x[0]
    return y


def sliding_correlation(x: np.ndarray, y: np.ndarray, size: int = 256, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Per window start: the largest normalised cross-correlation of Hann-windowed, demeaned stretches, and its lag."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    rho, lag = [], []
    for s in range(0, min(len(x), len(y)) - size + 1, step):
        a, b = ((v[s : s + size] - v[s : s + size].mean()) * w for v in (x, y))
        c = np.correlate(a, b, "full")
        n = math.sqrt((a @ a) * (b @ b))
        k = int(c.argmax())
        rho.append(c[k] / n if n > 0 else math.nan)
        lag.append(k - size + 1)
    return np.array(rho), np.array(lag)


def peaks(x: np.ndarray, height: float = -math.inf, distance: int = 1) -> np.ndarray:
    """Indices of local maxima of at least ``height``; of peaks closer than ``distance`` the tallest stay, first ones at ties."""
    if len(x) < 3:
        return np.empty(0, np.int64)
    edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))  # starts of level stretches
    v = x[edge]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = edge[top]
    at = at[x[at] >= height]
    keep = np.ones(len(at), bool)
    for i in np.lexsort((at, -x[at])):
        if keep[i]:
            near = np.abs(at - at[i]) < distance
            near[i] = False
            keep &= ~near
    return at[keep]
