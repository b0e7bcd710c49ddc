"""Small linear models: robust errors, influence, residual tests, mixed model, Bayes factor."""

from __future__ import annotations

import math

import numpy as np

from ...functions.dist import chi2_sf, normal_cdf, normal_ppf, t_sf2


def ols(x: np.ndarray, y: np.ndarray) -> dict:
    """Least squares with a constant in front: coefficients, HC3 errors, leverage, Cook's distance, DFBETAS, residuals."""
    x = np.column_stack([np.ones(len(y)), x])
    n, k = x.shape
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    s2 = e @ e / (n - k)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    loo = np.sqrt(np.maximum(0, (e @ e - e**2 / (1 - h)) / (n - k - 1)))
    shift = (inv @ x.T) * (e / (1 - h))
    se = np.sqrt(np.diag(cov))
    scale = np.concatenate(([np.nan], x[:, 1:].std(0, ddof=1) / y.std(ddof=1)))
    return {
        "b": b,
        "hc3": se,
        "p": np.array([t_sf2(t, n - k) for t in b / se]),
        "beta": b * scale,
        "r2": 1 - (e @ e) / ((y - y.mean()) ** 2).sum(),
        "leverage": h,
        "cook": e**2 * h / (k * s2 * (1 - h) ** 2),
        "dfbetas": (shift / (loo[None, :] * np.sqrt(np.diag(inv))[:, None])).T,
        "e": e,
        "x": x,
    }


def jarque_bera(e: np.ndarray) -> tuple[float, float]:
    e = e - e.mean()
    s2 = (e**2).mean()
    q = len(e) / 6 * ((e**3).mean() / s2**1.5) ** 2 + len(e) / 24 * ((e**4).mean() / s2**2 - 3) ** 2
    return float(q), chi2_sf(float(q), 2)


def breusch_pagan(x: np.ndarray, e: np.ndarray) -> tuple[float, float]:
    """n times the r2 of squared residuals on the design (constant included)."""
    u = e**2
    fit = x @ np.linalg.lstsq(x, u, rcond=None)[0]
    spread = ((u - u.mean()) ** 2).sum()
    q = len(e) * (1 - ((u - fit) ** 2).sum() / spread) if spread > 0 else 0.0
    return float(q), chi2_sf(float(q), x.shape[1] - 1)


def durbin_watson(e: np.ndarray) -> float:
    return float((np.diff(e) ** 2).sum() / (e @ e))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (n from 4 to 5,000)."""
    x, n = np.sort(x), len(x)
    m = np.array([normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    c = m / math.sqrt(m @ m)
    u = 1 / math.sqrt(n)
    # Royston's published polynomial coefficients.
    an = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, c[-1]], u)
    a = np.zeros(n)
    if n > 5:
        an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, c[-2]], u)
        phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = an1, -an1
    else:
        phi = (m @ m - 2 * m[-1] ** 2) / (1 - 2 * an**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = an, -an
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    y = math.log(1 - w)
    if n < 12:
        g = -2.273 + 0.459 * n
        y, mu, sd = -math.log(g - y), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        t = math.log(n)
        mu, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], t), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], t))
    return w, 1 - normal_cdf((y - mu) / sd)


def random_intercept_of_sums(t: dict[str, np.ndarray], centre: float, terms: tuple[str, str]) -> list[tuple]:
    """REML fit of y = a + b x + participant + error from sums by number of rows ``n``: profile over the variance ratio, golden section.

    With ratio r a participant of n rows has V^-1 = 1 - w(n) 11' in units of the residual variance, w = r / (1 + r n); so all
    that is asked of the data are the sums over all rows and, by n, the sums of products of participants' totals. y is
    less ``centre``, which goes back into the constant.
    """
    n, people = t["n"], t["people"]
    rows = float((n * people).sum())
    free = rows - 2
    square = np.array([[rows, t["x"].sum()], [t["x"].sum()] * 2])
    cross = np.array([t["y"].sum(), t["each_xy"].sum()])
    own = float(t["each_yy"].sum())

    def solve(ratio: float):
        w = ratio / (1 + ratio * n)
        a = square - np.array([[(w * n * n * people).sum(), (w * n * t["x"]).sum()], [(w * n * t["x"]).sum(), (w * t["xx"]).sum()]])
        c = cross - np.array([(w * n * t["y"]).sum(), (w * t["xy"]).sum()])
        det = a[0, 0] * a[1, 1] - a[0, 1] * a[1, 0]
        inverse = np.array([[a[1, 1], -a[0, 1]], [-a[1, 0], a[0, 0]]]) / det
        b = inverse @ c
        s2 = (own - (w * t["yy"]).sum() - b @ c) / free
        loss = free * math.log(s2) + (people * np.log1p(ratio * n)).sum() + math.log(det) if s2 > 0 and det > 0 else math.inf
        return loss, b, s2, inverse

    lo, hi, g = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, d) if solve(math.exp(c))[0] < solve(math.exp(d))[0] else (c, hi)
    ratio = math.exp((lo + hi) / 2)
    if solve(0.0)[0] <= solve(ratio)[0]:
        ratio = 0.0
    loss, b, s2, inverse = solve(ratio)
    if not math.isfinite(loss):
        return [(term, *[None] * 11, True) for term in terms]
    own_values = np.linalg.eigvalsh(square)
    condition = math.sqrt(own_values[1] / own_values[0]) if own_values[0] > 0 else math.inf
    likelihood = -0.5 * (loss + free * (1 + math.log(2 * math.pi)))
    out = []
    for i, term in enumerate(terms):
        estimate, se = float(b[i]) + (centre if i == 0 else 0.0), math.sqrt(s2 * inverse[i, i])
        z = estimate / se
        out.append((term, estimate, se, z, 2 * (1 - normal_cdf(abs(z))), estimate - 1.959963984540054 * se, estimate + 1.959963984540054 * se, ratio * s2, s2, ratio, likelihood, condition, ratio * s2 <= 1e-8 or ratio <= 1e-8))
    return out


def jzs_bayes_factor(t: float, n: int, r: float = math.sqrt(2) / 2) -> float:
    """Bayes factor for a paired difference with a Cauchy prior of scale ``r``, by quadrature over log g."""
    v = n - 1
    u = np.linspace(-20, 20, 8001)
    g = np.exp(u)
    f = (1 + n * r * r * g) ** -0.5 * (1 + t * t / ((1 + n * r * r * g) * v)) ** (-(v + 1) / 2) * (2 * np.pi) ** -0.5 * g**-1.5 * np.exp(-1 / (2 * g)) * g
    return float(np.trapezoid(f, u) / (1 + t * t / v) ** (-(v + 1) / 2))
