"""Distributions, tests, intervals and contrasts against known values and closed forms."""

from __future__ import annotations

import math
import time
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampflow.functions import columns, dist
from rampflow.operators import contrasts, mixed, prevalence, resampling
from rampflow.operators.kernels import bootstrap, regression, slopes

# Eighteen published paired differences and what was published of them.
DIFFERENCES = [
    -2.069326773435318, -1.7606875786240392, -6.32181159772577, -0.6857487116202381, -0.37423438715499735, -1.564170862228845,
    -0.5858370752226785, -10.408514885761239, -0.927663552342076, -0.12265432478356697, -0.3229530108363834, 0.10550030646347075,
    -0.4913739427578738, -2.392388579773658, -0.14557422766929307, -5.25240151414479, -3.539202506374837, -0.05370414936021284,
]


def test_published_contrast():
    d = np.array(DIFFERENCES)
    estimate, low, high = bootstrap.bca(d, "mean", seed=20260805)
    assert (estimate, low, high) == pytest.approx((-2.0507081874084636, -3.8125937386490705, -1.09512491343104), abs=1e-6)
    w, p, method = dist.signed_rank(d)
    assert (w, p, method) == (2, pytest.approx(2.288818359375e-05, rel=1e-12), "exact")
    assert bootstrap.STATISTICS["dz"](d) == pytest.approx(-0.7402088779335922)


@pytest.mark.parametrize(("w", "n", "p"), [(58, 18, 0.24620819091796875), (48, 18, 0.1083831787109375)])
def test_exact_rank_p(w, n, p):
    signs, left = np.ones(n), w
    for r in range(n, 0, -1):
        if r <= left:
            signs[r - 1], left = -1, left - r
    assert dist.signed_rank(signs * np.arange(1, n + 1))[:2] == (w, pytest.approx(p, rel=1e-12))


@pytest.mark.parametrize(("w", "n", "p"), [(33, 13, 0.38235208985751545), (9, 6, 0.7531523647659145)])
def test_normal_rank_p_with_zeros(w, n, p):
    signs, left = np.ones(n), w
    for r in range(n, 0, -1):
        if r <= left:
            signs[r - 1], left = -1, left - r
    got = dist.signed_rank(np.concatenate((signs * np.arange(1, n + 1), [0.0, 0.0])))
    assert got == (w, pytest.approx(p, rel=1e-9), "normal")


def test_rank_test_edges():
    assert dist.signed_rank(np.zeros(4)) == (0.0, 1.0, "all_zero")
    assert dist.signed_rank(np.array([np.nan]))[2] == "not_estimable"


@pytest.mark.parametrize("x", [0.1, 1.0, 3.84, 12.0, 60.0])
def test_distribution_identities(x):
    assert dist.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
    assert dist.chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-10)
    assert dist.f_sf(x, 1, 9) == pytest.approx(dist.t_sf2(math.sqrt(x), 9), rel=1e-10)
    assert dist.t_sf2(x, 1) == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-9)
    assert dist.beta_cdf(0.3, 2, x) + dist.beta_cdf(0.7, x, 2) == pytest.approx(1, rel=1e-12)


def test_quantiles_and_intervals():
    assert dist.t_ppf(0.975, 17) == pytest.approx(2.1098155778331806, rel=1e-9)
    assert dist.beta_ppf(dist.beta_cdf(0.37, 3, 5), 3, 5) == pytest.approx(0.37, rel=1e-9)
    assert dist.clopper_pearson(0, 10)[0] == 0 and dist.clopper_pearson(10, 10)[1] == 1
    low, high = dist.clopper_pearson(14, 18)
    tail = lambda p, ks: sum(math.comb(18, k) * p**k * (1 - p) ** (18 - k) for k in ks)
    assert tail(low, range(14, 19)) == pytest.approx(0.025) and tail(high, range(15)) == pytest.approx(0.025)
    assert dist.binomial_two_sided(1, 5) == pytest.approx(0.375) and dist.binomial_two_sided(0, 0) == 1


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.002, None])], "i int, p double")
    got = [r["q"] for r in columns.with_bh(df, "p", "q").orderBy("i").collect()]
    assert got == [pytest.approx(0.02), pytest.approx(0.04), pytest.approx(0.04), pytest.approx(0.008), None]


def test_exact_tail_of_many_trials():
    """Equal to whole numbers where those can be summed, and quick where they can't."""
    for n in (1_001, 2_500):
        for k in (0, 3, n // 3, n // 2 - 40, n // 2, n - 7):
            want = min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)), 2**n)))
            assert dist.binomial_two_sided(k, n) == pytest.approx(want, rel=1e-10, abs=1e-300)
    began = time.perf_counter()
    # A normal tail with continuity correction, at 1,000,000 trials.
    assert dist.binomial_two_sided(499_000, 1_000_000) == pytest.approx(2 * dist.normal_cdf((499_000.5 - 500_000) / 500), rel=1e-4)
    assert time.perf_counter() - began < 2


def test_bca_moves_with_the_data():
    d = np.array(DIFFERENCES)
    a, b = bootstrap.bca(d, seed=3, times=2000, tie_eps=32), bootstrap.bca(d + 10, seed=3, times=2000, tie_eps=32)
    assert [x + 10 for x in a] == pytest.approx(b)
    assert bootstrap.bca(d, seed=3, times=500) == bootstrap.bca(d, seed=3, times=500)
    assert math.isnan(bootstrap.bca(d[:2])[1]) and math.isnan(bootstrap.bca(np.ones(5), "dz")[1])


def pairs_of(spark, groups):
    return spark.createDataFrame([(g, f"{i:03}", float(a), float(b)) for g, (x, y) in groups.items() for i, (a, b) in enumerate(zip(x, y, strict=True))], "cohort string, subject string, x double, y double")


def test_perfect_negative_association(spark):
    x = np.arange(1.0, 19)
    plan = tuple(resampling.Analysis(*a) for a in (("pearson", 1_000), ("spearman", 1_000), ("theil_sen", 1_000), ("permutation", 2_000)))
    got = {r["analysis"]: r for r in resampling.paired(pairs_of(spark, {"a": (x, -3 * x)}), ["cohort"], "subject", "x", "y", plan, 1).collect()}
    for name, want in (("pearson", -1), ("spearman", -1), ("theil_sen", -3)):
        assert [got[name][c] for c in ("estimate", "low", "high")] == pytest.approx([want] * 3) and got[name]["p"] is None
    assert got["permutation"]["estimate"] == pytest.approx(-1) and got["permutation"]["p"] < 0.01


def test_draws_do_not_depend_on_tasks(spark, monkeypatch):
    """Units are the same whoever makes them; groups draw from streams of their own; short groups have no interval."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=40)
    df = pairs_of(spark, {"a": (x, x + rng.normal(size=40)), "b": (x, rng.normal(size=40)), "c": (x[:3], x[:3]), "d": (x[:9], np.ones(9))})
    plan = (resampling.Analysis("spearman", 1_700), resampling.Analysis("permutation", 1_300))
    run = lambda d: sorted(map(str, resampling.paired(d, ["cohort"], "subject", "x", "y", plan, 5).collect()))
    first = run(df)
    assert run(df.repartition(7)) == first
    rows = {(r["cohort"], r["analysis"]): r for r in resampling.paired(df, ["cohort"], "subject", "x", "y", plan, 5).collect()}
    assert rows["a", "spearman"]["low"] > 0 and rows["b", "permutation"]["p"] > 0.01 > rows["a", "permutation"]["p"]
    assert rows["c", "spearman"]["low"] is None and rows["d", "permutation"]["p"] is None
    n, hits = 1_300, 0
    a, b = bootstrap.ranks(x), bootstrap.ranks(np.array([r["y"] for r in df.where("cohort = 'a'").orderBy("subject").collect()]))
    for unit in range(3):
        mixed = b[np.argsort(resampling.stream(5, "permutation", ("a",), unit).random((min(500, n - 500 * unit), 40)), axis=1)]
        hits += int((np.abs(bootstrap.correlation(np.broadcast_to(a, mixed.shape), mixed)) >= abs(bootstrap.correlation(a, b)) - 1e-15).sum())
    assert rows["a", "permutation"]["p"] == (1 + hits) / (1 + n)


def test_intervals_in_tasks_equal_one_by_one(spark):
    rows = [(c, f"{i:02}", float(v) + k) for k, c in enumerate(("Stim-Pre", "Post-Pre")) for i, v in enumerate(DIFFERENCES)]
    got = {(r["contrast"], r["statistic"]): (r["estimate"], r["low"], r["high"]) for r in contrasts.intervals(spark.createDataFrame(rows, "contrast string, subject string, d double"), "contrast", times=500).collect()}
    for k, c in enumerate(("Stim-Pre", "Post-Pre")):
        for i, name in enumerate(bootstrap.STATISTICS):
            assert got[c, name] == bootstrap.bca(np.array([float(v) + k for v in DIFFERENCES]), name, 500, 20260805 + 10 * k + i)


def test_median_slope_by_all_pairs():
    rng = np.random.default_rng(0)
    for t in range(200):
        n = rng.integers(1, 60)
        x = rng.integers(0, rng.integers(1, 50), n).astype(float) if t % 2 else rng.normal(size=n)
        y = rng.integers(0, 8, n).astype(float) if t % 3 else rng.normal(size=n)
        i, j = np.triu_indices(n, 1)
        some = x[i] != x[j]
        pairs, slope = slopes.median_slope(x, y)
        assert pairs == some.sum()
        assert math.isnan(slope) if not some.any() else slope == pytest.approx(np.median(((y[j] - y[i])[some] / (x[j] - x[i])[some])), abs=1e-12)
    z = rng.integers(0, 20, 200)
    assert slopes.inversions(z) == sum(z[j] < z[i] for i in range(200) for j in range(i + 1, 200))


def test_median_slope_looks_at_few_pairs(monkeypatch):
    seen, plain = [], slopes._between
    monkeypatch.setattr(slopes, "_between", lambda *a: seen.append(len(found := plain(*a))) or found)
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    assert slopes.median_slope(x, 2 * x + rng.normal(size=3000))[1] == pytest.approx(2, abs=0.1)
    assert sum(seen) <= 2 * 8 * 3000  # of 4.5 million


def test_left_out_figures_equal_those_of_the_others():
    rng = np.random.default_rng(4)
    for t in range(150):
        n = int(rng.integers(3, 40))
        x = rng.integers(0, 6, n).astype(float) if t % 2 else rng.normal(size=n)
        y = rng.integers(0, 4, n).astype(float) if t % 3 else rng.normal(size=n) + 1e3 * (t % 5 == 0)
        x[0] = 1e9 if t % 7 == 0 else x[0]
        rest = [np.delete(np.arange(n), i) for i in range(n)]
        plain = lambda f: np.array([float(f(k)) for k in rest])  # noqa: E731, B023
        level = plain(lambda k: min(np.ptp(x[k]), np.ptp(y[k]))) == 0  # noqa: B023
        rho, r = plain(lambda k: bootstrap.correlation(bootstrap.ranks(x[k]), bootstrap.ranks(y[k]))), plain(lambda k: bootstrap.correlation(x[k], y[k]))  # noqa: B023
        for want, got in ((rho, bootstrap.omitted_spearman(x, y)), (r, bootstrap.omitted_correlation(x, y))):
            assert np.isnan(got[level]).all() and got[~level] == pytest.approx(want[~level], abs=1e-9)
        for name in ("mean", "median", "dz"):
            want, got = plain(lambda k: bootstrap.STATISTICS[name](x[k])), bootstrap.omitted(x, name)  # noqa: B023
            fine = plain(lambda k: np.ptp(x[k])) > 0 if name == "dz" else np.full(n, True)  # noqa: B023
            assert got[fine] == pytest.approx(want[fine], rel=1e-9, abs=1e-9)


def test_resampled_median_slopes_share_their_points(monkeypatch):
    """Medians of resamples are those of each alone, to the last bit, and hardly any is looked for alone."""
    rng, alone, plain = np.random.default_rng(6), [], slopes.Median.__call__
    x, y = rng.normal(size=2_400), rng.normal(size=2_400)
    monkeypatch.setattr(slopes.Median, "__call__", lambda *a: alone.append(1) or plain(*a))
    for a, b in ((x, y - x), (np.round(x, 1), y), (x, np.round(x + y, 1)), (x[np.arange(2_400) % 300], y[np.arange(2_400) % 300]), (np.where(np.arange(2_400) == 5, np.inf, x), y)):
        at = resampling.stream(1, "theil_sen", ("a",), 0).integers(0, 2_400, (30, 2_400))
        want = [slopes.median_slope(a[row], b[row])[1] for row in at]
        alone.clear()
        assert resampling._unit("theil_sen", resampling.stream(1, "theil_sen", ("a",), 0), a, b, 30).tolist() == want
        assert len(alone) < 10
    assert np.isnan(resampling._unit("theil_sen", rng, np.ones(400), y[:400], 3)).all()


def test_permutations_by_whole_numbers_are_those_of_draws():
    a, b = (resampling.stream(2, "permutation", ("a",), 3) for _ in range(2))
    for n in (1, 2, 257, 5_000):
        assert bootstrap.permuted(a, n).tolist() == np.argsort(b.random(n)).tolist()
    x = np.random.default_rng(8).integers(0, 9, 300).astype(float)
    y = np.roll(x, 1)
    mixed = y[np.argsort(resampling.stream(2, "permutation", ("b",), 0).random((200, 300)), axis=1)]
    far = np.abs(bootstrap.correlation(np.broadcast_to(x, mixed.shape), mixed)) >= abs(bootstrap.correlation(x, y)) - 1e-15
    assert bootstrap.as_far(x, y, 200, resampling.stream(2, "permutation", ("b",), 0)) == far.sum()


def test_draws_of_large_groups_take_little_memory():
    """Resamples are made in blocks of one stream, and a resample's median slope looks at few pairs."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=3_000)
    y, at = x + rng.normal(size=3_000), np.random.default_rng(1).integers(0, 3_000, (500, 3_000))
    i, j = np.triu_indices(3_000, 1)
    tracemalloc.start()
    slope = resampling._unit("theil_sen", np.random.default_rng(1), x, y, 8)
    rho = resampling._unit("spearman", np.random.default_rng(1), x, y, 500)
    resampling._unit("permutation", np.random.default_rng(1), x, y, 500)
    big = rng.normal(size=60_000)
    means = [bootstrap.bca(big, name, 500, 2) for name in ("mean", "median", "dz")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for k in range(3):
        a, b = x[at[k]], y[at[k]]
        dx = a[j] - a[i]
        assert slope[k] == pytest.approx(np.median((b[j] - b[i])[dx != 0] / dx[dx != 0]), abs=1e-12)
        assert rho[k] == bootstrap.correlation(bootstrap.ranks(a), bootstrap.ranks(b))
    assert all(low < estimate < high for estimate, low, high in means)


def flags(spark, rows):
    return spark.createDataFrame([(str(i), p, bool(v)) for i, r in enumerate(rows) for p, v in zip(("Pre", "Stim", "Post"), r, strict=True)], "subject string, phase string, flag boolean")


def test_cochran(spark):
    same = prevalence.cochran(flags(spark, [(1, 1, 1)] * 18), "flag").first()
    assert (same["q"], same["p"], same["status"]) == (None, None, "not_estimable")
    legacy = prevalence.cochran(flags(spark, [(1, 1, 1)] * 18), "flag", legacy_degenerate=True).first()
    assert (legacy["q"], legacy["p"]) == (0.0, 1.0)
    mixed = prevalence.cochran(flags(spark, [(1, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)]), "flag").first()
    assert mixed["status"] == "estimable" and mixed["p"] == pytest.approx(math.exp(-mixed["q"] / 2))
    counts = {r["contrast"]: (r["first_only"], r["second_only"]) for r in prevalence.mcnemar(flags(spark, [(1, 0, 0), (1, 1, 0), (0, 1, 1), (1, 0, 1)]), "flag").collect()}
    assert counts["Stim-Pre"] == (1, 2)
    p = {r["contrast"]: r["p"] for r in prevalence.mcnemar_p(prevalence.mcnemar(flags(spark, [(1, 1, 1)] * 18), "flag")).collect()}
    assert set(p.values()) == {1.0}


def test_pairs_are_complete_and_unique(spark):
    rows = [("1", "Pre", 1.0), ("1", "Stim", 2.0), ("2", "Pre", 1.0), ("2", "Stim", None), ("3", "Pre", 5.0), ("3", "Stim", 3.0)]
    df = spark.createDataFrame(rows, "subject string, phase string, v double")
    s = contrasts.summary(contrasts.differences(df, "v"), "contrast").first()
    assert (s["contrast"], s["n"], s["mean_difference"], s["n_negative"]) == ("Stim-Pre", 2, -0.5, 1)
    with pytest.raises(Exception, match="occurs twice"):
        contrasts.wide(df.union(df), "v").collect()


def test_leave_one_out_equals_jackknife(spark):
    df = spark.createDataFrame([(str(i), "c", d) for i, d in enumerate(DIFFERENCES)], "subject string, contrast string, d double")
    a = {r["omitted"]: r["mean"] for r in contrasts.leave_one_out(df, "contrast").collect()}
    b = {r["omitted"]: r["mean"] for r in contrasts.jackknife_means(df, "contrast").collect()}
    assert a == {k: pytest.approx(v) for k, v in b.items()}


def test_safe_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "x double, y double")
    r = df.agg(columns.pearson("x", "y").alias("r"), columns.slope("y", "x").alias("s"), columns.cohens_dz("y").alias("z"), columns.cohens_dz("y", 0.0).alias("z0")).first()
    assert tuple(r) == (None, 0.0, None, None)
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "x double")
    assert [x[0] for x in nan.select(columns.finite(F.col("x"))).collect()] == [False, False, False, True]


def test_classes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 18), (-2.0, -1.0, 18), (-1.0, 1.0, 18), (1.0, 2.0, 14)], "low double, high double, n int")
    assert [r["class"] for r in contrasts.classify(df, "low", "high", "n").collect()] == ["increase", "decrease", "no_clear_change", "inconclusive"]


def test_linear_model():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(0, 0.1, 60)
    m = regression.ols(x, y)
    assert m["b"] == pytest.approx([1, 2, -1], abs=0.1) and m["r2"] > 0.98
    assert m["leverage"].sum() == pytest.approx(3)
    i = 7
    keep = np.arange(60) != i
    assert m["b"] - regression.ols(x[keep], y[keep])["b"] == pytest.approx((m["dfbetas"][i] * np.sqrt(np.diag(np.linalg.inv(m["x"].T @ m["x"]))) * np.sqrt((regression.ols(x[keep], y[keep])["e"] ** 2).sum() / 56)), rel=1e-6)
    assert 1 < regression.durbin_watson(m["e"]) < 3
    assert regression.shapiro_wilk(m["e"])[1] > 0.01 > regression.shapiro_wilk(np.exp(rng.normal(0, 2, 60)))[1]
    assert regression.jarque_bera(np.exp(rng.normal(0, 1, 200)))[1] < 0.01


def model_rows(spark, people=80, each=12, spread=2.0, effect=1.5, seed=1, base=3.0):
    rng = np.random.default_rng(seed)
    u = rng.normal(0, spread, people)
    rows = [("all", f"{g:03}", float(base + u[g] + effect * (i % 2) + rng.normal()), bool(i % 2)) for g in range(people) for i in range(each)]
    return spark.createDataFrame(rows, "cohort string, subject string, y double, x boolean"), rows


def test_mixed_model_recovers_variances(spark):
    df, rows = model_rows(spark)
    fit = mixed.random_intercept(df, "y", "x", "cohort")
    by = {r["term"]: r for r in fit.collect()}
    assert by["constant"]["b"] == pytest.approx(3, abs=0.7) and by["effect"]["b"] == pytest.approx(1.5, abs=0.2) and by["effect"]["p"] < 1e-6
    assert {r["status"] for r in by.values()} == {"estimable"} and by["effect"]["eligible"] and by["effect"]["rows"] == 960
    # A balanced layout with the effect inside participants has closed REML estimates.
    y = np.array([r[2] for r in rows]).reshape(80, 12)
    line = np.where(np.arange(12) % 2, by["effect"]["b"], 0.0)
    assert by["effect"]["b"] == pytest.approx(y[:, 1::2].mean() - y[:, ::2].mean())
    within = ((y - line - (y - line).mean(1, keepdims=True)) ** 2).sum() / (80 * 11 - 1)
    assert by["effect"]["residual_variance"] == pytest.approx(within, rel=1e-5)
    assert by["effect"]["group_variance"] == pytest.approx(y.mean(1).var(ddof=1) - within / 12, rel=1e-4)
    assert by["effect"]["se"] == pytest.approx(math.sqrt(4 * within / 960), rel=1e-5)
    shape = mixed.residual_shape(mixed.residuals(df, fit, "y", "x", "cohort"), "cohort").first()
    shrink = by["effect"]["group_variance"] / (by["effect"]["group_variance"] + within / 12)
    left = (y - line) - by["constant"]["b"] - shrink * ((y - line).mean(1, keepdims=True) - by["constant"]["b"])
    assert (shape["n"], shape["sd"]) == (960, pytest.approx(left.std(ddof=1), rel=1e-5)) and abs(shape["skewness"]) < 0.3 and abs(shape["excess_kurtosis"]) < 0.6


def test_mixed_model_of_unequal_participants_and_large_offsets(spark):
    """By the definition, V of every participant, and the same with 1e6 added to all."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(25):
        u = rng.normal()
        for i in range(rng.integers(5, 40)):
            x = bool(i < 2 or (i > 3 and rng.random() < 0.3))
            rows.append(("all", f"{g}", float(u + 0.7 * x + rng.normal()), x))
    schema = "cohort string, subject string, y double, x boolean"
    one = mixed.random_intercept(spark.createDataFrame(rows, schema), "y", "x", "cohort").where("term = 'effect'").first()
    far = mixed.random_intercept(spark.createDataFrame([(c, g, y + 1e6, x) for c, g, y, x in rows], schema), "y", "x", "cohort").where("term = 'effect'").first()
    assert [one[c] for c in ("b", "se", "group_variance")] == pytest.approx([far[c] for c in ("b", "se", "group_variance")], rel=1e-4)
    y, d = np.array([r[2] for r in rows]), np.column_stack([np.ones(len(rows)), [r[3] for r in rows]])
    who = np.array([r[1] for r in rows])

    def loss(ratio):
        v = np.eye(len(y)) + ratio * (who[:, None] == who)
        a = d.T @ np.linalg.solve(v, d)
        e = y - d @ np.linalg.solve(a, d.T @ np.linalg.solve(v, y))
        return (len(y) - 2) * math.log(e @ np.linalg.solve(v, e) / (len(y) - 2)) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]

    at = one["variance_ratio"]
    assert loss(at) <= min(loss(at * 1.01), loss(at * 0.99)) + 1e-9
    assert one["log_likelihood"] == pytest.approx(-0.5 * (loss(at) + (len(y) - 2) * (1 + math.log(2 * math.pi))), rel=1e-9)


def test_mixed_model_gate_and_singular_fits(spark):
    df, _ = model_rows(spark, people=6, each=4)
    short = df.unionByName(spark.createDataFrame([("all", "zz", 1.0, True), ("all", "zz", 2.0, True), ("all", "zz", None, False)], df.schema))
    r = mixed.random_intercept(short, "y", "x", "cohort").collect()
    assert [(x["term"], x["eligible"], x["least_rows"], x["status"], x["reason"]) for x in r] == [(None, False, 0, "not_estimable", "eligibility_gate_failed")]
    flat = spark.createDataFrame([("all", f"{g}", float(v), x) for g in range(8) for v, x in ((1, False), (3, False), (2, True), (4, True))], df.schema)
    r = mixed.random_intercept(flat, "y", "x", "cohort").where("term = 'effect'").first()
    assert r["singular"] and r["b"] == pytest.approx(1.0) and (r["status"], r["reason"]) == ("not_estimable", "nonconvergence_or_singular_random_intercept")
    assert mixed.residuals(flat, mixed.random_intercept(flat, "y", "x", "cohort"), "y", "x", "cohort").collect() == []
    assert mixed.random_intercept(df.limit(0), "y", "x", "cohort").collect() == []


def test_mixed_model_keeps_the_sign_of_what_rounds_to_zero(spark):
    from rampflow.plans.kernel_queries import _signed

    df = spark.createDataFrame([(v,) for v in (-0.00001, 0.00001, -0.00005, -1.23456, 1.23456, float("nan"), None)], "b double")
    assert [str(r["b"]) for r in _signed(df, "b", digits=4).collect()] == ["-0.0", "0.0", "-0.0001", "-1.2346", "1.2346", "None", "None"]


def test_bayes_factor():
    assert regression.jzs_bayes_factor(0.0, 18) < 0.3
    assert regression.jzs_bayes_factor(5.0, 18) > 100
