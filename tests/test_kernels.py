"""Spectra, autoregression and neighbour estimators against closed forms and simulated truth."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest

from rampflow.operators.kernels import nonlinear, spectral, var


def test_splines_reproduce_polynomials():
    x = np.array([0.0, 1, 2.5, 3, 4.2, 6])
    at = np.linspace(0, 6, 31)
    assert spectral.cubic_spline(x, 2 + 3 * x, at) == pytest.approx(2 + 3 * at)
    assert spectral.cubic_spline(x, x**3 - x, at, "not-a-knot") == pytest.approx(at**3 - at)
    y = np.sin(x)
    assert spectral.cubic_spline(x, y, x) == pytest.approx(y)


def test_resampling_rules():
    t = np.arange(0, 10, 0.8)
    grid, (y,) = spectral.resample(t, [t * 2])
    assert grid[-1] < t[-1] and y == pytest.approx(2 * grid)
    assert len(spectral.resample(t[:3], [t[:3]])[0]) == 0
    with pytest.raises(ValueError, match="ascend"):
        spectral.resample(t[::-1], [t])


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(1196, 512, 256, 3), (1196, 256, 128, 8), (255, 256, 128, 0)])
def test_segment_counts(n, size, overlap, want):
    assert spectral.segment_count(n, size, overlap) == want


def test_density_integrates_to_variance_and_coherence_is_bounded():
    rng = np.random.default_rng(20260805)
    x = rng.normal(size=40_000)
    f, p = spectral.cross_spectrum(x, x, 256, 128)
    assert np.trapezoid(p.real, f) == pytest.approx(x.var(), rel=0.05)
    shared = rng.normal(size=1200)
    a, b = shared + 0.3 * rng.normal(size=1200), shared + 0.3 * rng.normal(size=1200)
    for size, overlap in ((512, 256), (256, 128)):
        c, u = spectral.coherence(a, b, size, overlap), spectral.coherence(a, rng.normal(size=1200), size, overlap)
        assert 0 <= u < c <= 1
    assert math.isnan(spectral.coherence(a[:100], b[:100]))


def test_surrogates_keep_amplitudes():
    x = np.random.default_rng(1).normal(size=1200)
    for y in (x, x[:-1]):
        s = spectral.phase_surrogate(y, np.random.default_rng(2))
        assert np.abs(np.fft.rfft(s)) == pytest.approx(np.abs(np.fft.rfft(y)), abs=1e-10)
    seen, edge, p, hits = spectral.coherence_test(x, x + 0.1 * np.random.default_rng(3).normal(size=1200), 19, 4)
    assert seen > edge and hits == 0 and p == 0.05


def test_band_pass():
    t = np.arange(4000)
    middle, outside = np.sin(np.pi * 0.1 * t), np.sin(np.pi * 0.4 * t)
    gain = lambda x: np.abs(spectral.chebyshev_band(x, 0.08, 0.12)[2000:]).max()
    assert gain(middle) > 0.3 and gain(outside) < 0.02


def test_sliding_correlation_finds_a_lag():
    x = np.cumsum(np.random.default_rng(5).normal(size=600))
    rho, lag = spectral.sliding_correlation(x[3:], x[:-3], 128, 64)
    assert np.median(lag) == -3 and (rho > 0.8).all()


def test_peaks():
    x = np.array([0, 3, 0, 2, 0, 0, 5, 5, 0, 1, 0.0])
    assert spectral.peaks(x).tolist() == [1, 3, 6, 9]
    assert spectral.peaks(x, 1.5).tolist() == [1, 3, 6]
    assert spectral.peaks(x, distance=3).tolist() == [1, 6, 9]


def pair(coupled: bool, seed: int):
    rng = np.random.default_rng(seed)
    s, r = np.zeros(800), np.zeros(800)
    for i in range(1, 800):
        s[i] = (0.62 if coupled else 0.55) * s[i - 1] + rng.normal(scale=0.8 if coupled else 1.0)
        r[i] = (0.48 * r[i - 1] + 0.85 * s[i - 1] if coupled else 0.45 * r[i - 1]) + rng.normal(scale=0.8 if coupled else 1.0)
    return 120 + s, 800 + r


def test_autoregression_finds_the_direction():
    r = var.analyse(*pair(False, 20260806))
    assert r["reason"] == "NA" and r["p_forward"] >= 0.05 and r["p_reverse"] >= 0.05
    r = var.analyse(*pair(True, 20260807))
    assert r["p_forward"] < 0.001 and r["p_reverse"] > 0.05 and r["stable"]


def test_autoregression_failures_are_rows():
    s, r = pair(False, 1)
    for a, b in ((s[:40], r[:40]), (np.where(np.arange(800) == 3, np.nan, s), r), (s, -r), (np.full(800, 120.0), r)):
        got = var.analyse(a, b)
        assert got["order"] is None and got["reason"] != "NA"


def test_order_of_a_known_process():
    rng = np.random.default_rng(7)
    y = np.zeros((3000, 2))
    for i in range(2, 3000):
        y[i] = 0.5 * y[i - 1] - 0.4 * y[i - 2] + rng.normal(size=2)
    assert var.select_order(y)[0] == 2
    b, _ = var.ols(*var.lagged(y, 2))
    assert var.companion_modulus(b, 2) == pytest.approx(math.sqrt(0.4), abs=0.05)


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 60).astype(float)  # many ties
    d = np.abs(x[:, None] - x)
    near, far = nonlinear.neighbours(d, 4, 2)
    for i in range(60):
        want = sorted((d[i, j], j) for j in range(60) if abs(i - j) > 2)[:4]
        assert [(far[i, k], near[i, k]) for k in range(4)] == want
    with pytest.raises(ValueError, match="fewer"):
        nonlinear.neighbours(d, 58, 2)


def test_pair_probability_is_strict():
    assert nonlinear.pair_probability(np.array([0.0, 1.0, 2.0]), 1.0) == 0
    assert nonlinear.pair_probability(np.array([0.0, 0.5, 2.0]), 1.0) == pytest.approx(1 / 3)


@pytest.mark.parametrize("method", ["LP", "CE", "SSC"])
def test_estimators_order_the_directions(method):
    right = 0
    for replicate in range(4):
        x, y = nonlinear.simulate("unidirectional_nonlinear_X_to_Y", 0, replicate)
        right += nonlinear.estimate(method, y, x)["strength"] > nonlinear.estimate(method, x, y)["strength"]
    assert right >= 3


def test_estimator_failures_are_rows():
    got = nonlinear.estimate("LP", np.full(50, np.nan), np.zeros(50))
    assert math.isnan(got["strength"]) and got["reason"] == "invalid or short input"
    assert nonlinear.estimate("SSC", np.zeros(20), np.zeros(20))["reason"] == "series too short"
    assert nonlinear.estimate("CE", np.zeros(60), np.arange(60.0))["reason"].startswith("the target's entropy")


def test_shifts():
    s = nonlinear.shift_offsets(256, 500, np.random.default_rng(1))
    assert s.min() >= 32 and s.max() <= 224
    with pytest.raises(ValueError, match="short"):
        nonlinear.shift_offsets(60, 3, np.random.default_rng(1))


def test_stationarity_flag():
    x = np.random.default_rng(2).normal(size=400)
    assert nonlinear.kpss(x)[1] and not nonlinear.kpss(np.cumsum(x))[1]


def test_neighbours_in_blocks_of_rows(monkeypatch):
    """Long series are never held as a whole matrix of distances; blocks give the same neighbours."""
    x, y = nonlinear.simulate("unidirectional_linear_X_to_Y", 0, 1, n=300)
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    whole = nonlinear.neighbours(d, 7, 3)
    monkeypatch.setattr(nonlinear, "HELD", 4_000)
    for a, b in zip(whole, nonlinear.neighbours(nonlinear.Distances(x, y), 7, 3), strict=True):
        assert (a == b).all()


def test_coupling_sensitivity_is_registered_whole(spark):
    """All eight settings and both methods, the whole-phase setting among them."""
    import __spark_entry__
    from rampflow.schema import NEIGHBOURS

    got = __spark_entry__.queries()["coupling_sensitivity"](spark, "/root/testdata/sf0.01").select("setting", "method", "direction").collect()
    assert {tuple(r) for r in got} == {(s.name, m, d) for s in NEIGHBOURS for m in ("CE", "LP") for d in ("sbp_to_rri", "rri_to_sbp")}


def test_neighbours_over_many_columns_look_at_few_pairs(monkeypatch):
    """long series of three columns and more, ties and tails among them, never read a row of all distances."""
    rng = np.random.default_rng(8)
    for n, k, theiler, digits, columns in ((1_500, 30, 8, 9, 5), (1_200, 7, -1, 1, 3), (1_100, 4, 2, 0, 4), (5_000, 10, 8, 9, 3)):
        x = np.round(rng.standard_t(2, size=(columns, n)), digits)
        d = np.abs(x[:, :, None] - x[:, None]).max(0)
        want = nonlinear.neighbours(d, k, theiler)
        seen, apart = [], nonlinear._apart
        with monkeypatch.context() as m:
            m.setattr(nonlinear.Distances, "__getitem__", lambda *a: pytest.fail("all pairs"))
            m.setattr(nonlinear, "_apart", lambda c, rows, others, t: seen.append(len(rows) * len(others)) or apart(c, rows, others, t))
            near, far = nonlinear.neighbours(nonlinear.Distances(*x, theiler=theiler), k, theiler)
        assert (far == want[1]).all() and (near == want[0]).all()
        assert n < 5_000 or sum(seen) < n * n / 2


def test_coupling_sensitivity_makes_each_estimate_once(spark):
    """a job a cell, setting, method and direction, and no second run of them all for the primary setting's signs."""
    from rampflow.plans import analyses

    beats = spark.createDataFrame([("a", "Pre", 1, 0.0, 1.0, 1.0)], "subject string, phase string, beat_idx int, t double, rri double, sbp double")
    plan = analyses.coupling_sensitivity(beats)["effects"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 3  # a segment length each


@pytest.mark.parametrize(("n", "size", "overlap"), [(700, 128, 64), (701, 128, 96), (640, 127, 63), (128, 128, 64)])
def test_surrogates_in_blocks_equal_one_by_one(n, size, overlap):
    rng = np.random.default_rng(5)
    x, y = spectral.detrend(rng.normal(size=n)), spectral.detrend(rng.normal(size=n).cumsum())
    for band in ((0.08, 0.4), (0.0, 2.0)):
        o = {"size": size, "overlap": overlap, "rate": 4.0, "band": band}
        one = np.random.default_rng(9)
        want = [spectral._coherence(spectral.phase_surrogate(x, one), spectral.phase_surrogate(y, one), **o) for _ in range(70)]
        assert spectral.surrogate_coherence(x, y, 70, np.random.default_rng(9), **o) == pytest.approx(want, rel=1e-9)


def test_windowed_search_equals_all_pairs():
    """Ties, short series and rows with fewer neighbours than asked for; and no more than a window's worth of distances."""
    rng = np.random.default_rng(4)
    for n, k, theiler in ((900, 5, 3), (300, 7, -1), (40, 6, 4), (9, 4, 2), (3, 2, 0), (1, 2, 0)):
        x, y = np.round(rng.normal(size=n), 1), np.round(rng.normal(size=n), 1)
        d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
        at = np.arange(n)
        d = np.where(np.abs(at[:, None] - at) <= theiler, np.inf, d)
        near, far, there = nonlinear.nearest_there((x, y), k, theiler)
        for i in range(n):
            want = sorted((d[i, j], j) for j in range(n) if np.isfinite(d[i, j]))[:k]
            assert [(float(f), int(j)) for f, j, ok in zip(far[i], near[i], there[i], strict=True) if ok] == want


def test_long_series_equal_short_ones(monkeypatch):
    """Estimates do not depend on whether matrices are held, made in blocks or replaced by windows."""
    x, y = nonlinear.simulate("bidirectional_X_to_Y_stronger", 0, 2, n=200)
    held = [nonlinear.estimate(m, x, y, **o) for m, o in (("LP", {"depth": 3}), ("CE", {"depth": 3}), ("SSC", {}))]
    monkeypatch.setattr(nonlinear, "HELD", 5_000)
    again = [nonlinear.estimate(m, x, y, **o) for m, o in (("LP", {"depth": 3}), ("CE", {"depth": 3}), ("SSC", {}))]
    assert [(e["strength"], e["embedding"], e["curve"]) for e in held] == [(e["strength"], e["embedding"], e["curve"]) for e in again]


@pytest.mark.parametrize("method", ["LP", "CE", "SSC"])
def test_shifts_share_the_target(method, monkeypatch):
    """Scores of the target alone are made once for all shifts, and the estimates are those of one at a time."""
    x, y = nonlinear.simulate("uncoupled_linear", 0, 1, n=128)
    options = {} if method == "SSC" else {"depth": 4}
    calls, plain = [], nonlinear.neighbours
    monkeypatch.setattr(nonlinear, "neighbours", lambda *a, **o: calls.append(1) or plain(*a, **o))
    one = [nonlinear.estimate(method, x, np.roll(y, s), **options) for s in (0, 40, 60, 80)]
    alone, calls[:] = len(calls), []
    assert [e["curve"] for e in nonlinear.shifted(method, x, y, (0, 40, 60, 80), **options)] == [e["curve"] for e in one]
    assert len(calls) < alone or method == "SSC"


def test_pairs_by_sorting():
    rng = np.random.default_rng(6)
    for n, tolerance in ((2, 0.3), (57, 0.1), (200, 1e-9), (200, 0.7)):
        v = np.round(rng.normal(size=n), 1)
        i, j = np.triu_indices(n, 1)
        assert nonlinear.pair_probability(v, tolerance) == (np.abs(v[i] - v[j]) < tolerance).mean()
        rows = np.round(rng.normal(size=(20, 9)), 1)
        i, j = np.triu_indices(9, 1)
        assert (nonlinear.close_pairs(rows, tolerance) == (np.abs(rows[:, i] - rows[:, j]) < tolerance).sum(1)).all()


@pytest.mark.parametrize("n", [4, 5, 6, 40])
def test_not_a_knot_ends(n):
    """The third derivative goes on through the second and the last but one knot, as in the dense system."""
    rng = np.random.default_rng(n)
    x, y = np.cumsum(0.1 + rng.random(n)), rng.normal(size=n)
    for a, b, c in ((x[0], x[1], x[2]), (x[-3], x[-2], x[-1])):
        third = []
        for lo, hi in ((a, b), (b, c)):
            at = np.linspace(lo, hi, 4)
            third.append(np.polyfit(at, spectral.cubic_spline(x, y, at, "not-a-knot"), 3)[0])
        assert third[0] == pytest.approx(third[1], rel=1e-5)
    assert spectral.cubic_spline(x, y, x, "not-a-knot") == pytest.approx(y)


def test_nested_orders_equal_separate_fits():
    rng = np.random.default_rng(9)
    for _ in range(10):
        y = np.cumsum(rng.normal(size=(150, 2)), 0) * 0.1 + rng.normal(size=(150, 2))
        best, criteria = var.select_order(y, 0)
        want = []
        for p in range(11):
            x, r = var.lagged(y, p, 10)
            e = var.ols(x, r)[1]
            want.append(np.linalg.slogdet(e.T @ e / 140)[1] + 2 * (4 * p + 2) / 140)
        assert criteria == pytest.approx(want, abs=1e-9) and best == int(np.argmin(want))


def test_autoregression_of_long_series_holds_no_design(monkeypatch):
    """Rows in blocks give the fit of the whole design; a long cell takes little more than its own series."""
    rng = np.random.default_rng(8)
    s = np.cumsum(rng.normal(size=900)) * 0.1 + rng.normal(size=900)
    r = 5 + np.roll(s, 1) * 0.1 + rng.normal(size=900) * 0.1
    whole = var.analyse(s, r, positive=False)
    monkeypatch.setattr(var, "ROWS", 64)
    parts = var.analyse(s, r, positive=False)
    assert whole["reason"] == "NA" and whole["order"] == parts["order"]
    assert all(parts[k] == pytest.approx(whole[k], rel=1e-7, abs=1e-10) for k in whole if k != "reason")
    y = np.column_stack([s, r])
    b, e = var.ols(*var.lagged(y, 3))
    found = var.fit(y, 3)
    assert found[0] == pytest.approx(b, abs=1e-10) and found[1] == pytest.approx(e, abs=1e-10)
    monkeypatch.undo()
    s, r = rng.normal(size=300_000), 9 + rng.normal(size=300_000)
    tracemalloc.start()
    assert var.analyse(s, r, positive=False)["reason"] == "NA"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
