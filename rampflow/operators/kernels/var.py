"""Vector autoregression of two series: order, fit, stability, residual tests and causality."""

from __future__ import annotations

import math

import numpy as np

from ...functions.dist import chi2_sf, f_sf
from .spectral import detrend

#: Rows of a design that are held at once.
ROWS = 1 << 14


def lagged(y: np.ndarray, p: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(design with constant and p lags, response), dropping the first ``skip`` rows (p by default)."""
    skip = p if skip is None else skip
    n = len(y)
    return np.hstack([np.ones((n - skip, 1)), *[y[skip - k : n - k] for k in range(1, p + 1)]]), y[skip:]


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return b, y - x @ b


def triangle(y: np.ndarray, p: int) -> np.ndarray:
    """Triangle of the orthogonal factorisation of [design, response], some rows at a time: what is held goes on top of the next rows."""
    held = np.empty((0, 1 + y.shape[1] * (p + 1)))
    for a in range(p, len(y), ROWS):
        held = np.linalg.qr(np.vstack([held, np.hstack(lagged(y[a - p : a + ROWS], p))]), mode="r")
    return held


def fit(y: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients and residuals of order p, and the triangle of its design; no whole design is held."""
    t, m = triangle(y, p), 1 + y.shape[1] * p
    b = np.linalg.lstsq(t[:m, :m], t[:m, m:], rcond=np.finfo(float).eps * max(len(y) - p, m))[0]
    e = np.empty((len(y) - p, y.shape[1]))
    for a in range(p, len(y), ROWS):
        x, r = lagged(y[a - p : a + ROWS], p)
        e[a - p : a - p + len(r)] = r - x @ b
    return b, e, t[:m, :m]


def select_order(y: np.ndarray, lowest: int = 1, highest: int = 10) -> tuple[int, list[float]]:
    """Order of least AIC on the sample that all orders share.

    Regressors come order by order, so one orthogonal factorisation holds all fits: what order p leaves of the response
    is in the rows of its triangle below the regressors of p.
    """
    n, k = len(y) - highest, y.shape[1]
    whole = triangle(y, highest)[:, -k:]
    out = []
    for p in range(lowest, highest + 1):
        left = whole[1 + k * p :]
        sign, logdet = np.linalg.slogdet(left.T @ left / n)
        out.append(logdet + 2 * (k * k * p + k) / n if sign > 0 else math.inf)
    best = int(np.nanargmin(out))
    if not math.isfinite(out[best]):
        raise ValueError("no finite criterion")
    return best + lowest, out


def companion_modulus(b: np.ndarray, p: int, k: int = 2) -> float:
    a = b[1:].T  # [k, k * p]
    c = np.zeros((k * p, k * p))
    c[:k] = a
    c[k:, :-k] = np.eye(k * (p - 1))
    return float(np.abs(np.linalg.eigvals(c)).max())


def portmanteau(e: np.ndarray, lags: int, p: int) -> tuple[float, int, float]:
    """Adjusted multivariate portmanteau statistic of residuals, its degrees of freedom and p."""
    n, k = e.shape
    e = e - e.mean(0)
    c0 = np.linalg.inv(e.T @ e / n)
    q = 0.0
    for h in range(1, lags + 1):
        c = e[h:].T @ e[:-h] / n
        q += np.trace(c.T @ c0 @ c @ c0) / (n - h)
    q, df = float(q * n * n), k * k * (lags - p)
    return q, df, chi2_sf(q, df)


def normality(e: np.ndarray) -> tuple[float, int, float]:
    """Omnibus skewness and kurtosis of Cholesky-standardised residuals, its degrees of freedom and p."""
    n, k = e.shape
    e = e - e.mean(0)
    w = np.linalg.solve(np.linalg.cholesky(e.T @ e / n), e.T)
    skew, kurt = (w**3).mean(1), (w**4).mean(1) - 3
    q = float(n * (skew @ skew) / 6 + n * (kurt @ kurt) / 24)
    return q, 2 * k, chi2_sf(q, 2 * k)


def causality(y: np.ndarray, p: int, caused: int, causing: int) -> tuple[float, float]:
    """F statistic and p that all lags of ``causing`` are zero in the equation of ``caused``; df p and k * (n - k p - 1)."""
    b, e, t = fit(y, p)
    n, k = e.shape
    free = n - (k * p + 1)
    s = e.T @ e / free
    at = [1 + k * i + causing for i in range(p)]
    cov = np.linalg.inv(t.T @ t)[np.ix_(at, at)] * s[caused, caused]
    v = b[at, caused]
    f = float(v @ np.linalg.solve(cov, v)) / p
    return f, f_sf(f, p, k * free)


def analyse(sbp: np.ndarray, rri: np.ndarray, lowest: int = 1, highest: int = 10, positive: bool = True) -> dict:
    """All results of one cell; ``reason`` is NA or why there are none. Never raises. Splines may cut below 0: not ``positive``."""
    names = ("order", "n_obs", "modulus", "stable", "whiteness_p", "normality_p", "f_forward", "p_forward", "f_reverse", "p_reverse")
    try:
        if len(sbp) != len(rri) or len(sbp) <= 5 * highest:
            raise ValueError("too few observations")
        if not (np.isfinite(sbp).all() and np.isfinite(rri).all()) or (positive and (rri <= 0).any()):
            raise ValueError("non-finite values or non-positive intervals")
        series = [detrend(np.asarray(v, float)) for v in (sbp, rri)]
        if min(v.std() for v in series) <= 0:
            raise ValueError("no variation")
        y = np.column_stack([(v - v.mean()) / v.std() for v in series])
        p, _ = select_order(y, lowest, highest)
        if not p:
            raise ValueError("the criterion chose order zero")
        b, e, _ = fit(y, p)
        lags = max(20, p + 5)
        if lags >= len(e):
            raise ValueError("too few residuals for the whiteness test")
        modulus = companion_modulus(b, p)
        forward, reverse = causality(y, p, 1, 0), causality(y, p, 0, 1)
        values = (p, len(e), modulus, modulus < 1, portmanteau(e, lags, p)[2], normality(e)[2], *forward, *reverse)
        return dict(zip(names, values, strict=True)) | {"reason": "NA"}
    except (ValueError, np.linalg.LinAlgError) as why:
        return dict.fromkeys(names) | {"reason": f"{type(why).__name__}:{why}"}
