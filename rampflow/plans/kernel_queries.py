"""Queries of the numeric estimators, and of their relational parts where SQL can express them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import contrasts, linear, mixed, ramps, resampling, segment
from ..operators.grouped import per_group
from ..operators.kernels import nonlinear, regression, spectral, var
from ..schema import CANONICAL, CELL
from . import sql
from .beat_queries import beats, rnd, tasks
from .registry import query

R = sql.rounded
#: Beats of a series that the neighbour estimators look at, from the middle of the cell.
SEGMENT = 256


def _long(spark, sf_dir):
    """Cells of the event types, in hours."""
    return beats(spark, sf_dir, "event_type").withColumn("t", F.col("t") / 3600.0)


def _cells(df, values, kernel, schema, keys=CELL):
    return per_group(df, keys, ["beat_idx"], values, kernel, schema)


# Spectra ----------------------------------------------------------------------------------------


def _uniform(t, *series):
    return spectral.resample(t, list(series))[1]


@query("coherence_band")
def coherence_band(spark, sf_dir):
    def kernel(key, t, s, r):
        s, r = _uniform(t, s, r)
        return len(s), spectral.segment_count(len(s), 256, 128), spectral.coherence(s, r, 256, 128, band=(0.3, 0.6)), spectral.band_power(r, 0.3, 0.6)

    return rnd(_cells(_long(spark, sf_dir), ["t", "sbp", "rri"], kernel, "n long, segments long, coherence double, power double"), "coherence", "power")


@query("coherence_surrogates")
def coherence_surrogates(spark, sf_dir):
    def kernel(key, t, s, r):
        s, r = _uniform(t, s, r)
        return spectral.coherence_test(s, r, 1_000, seed=[20260805, *map(ord, "/".join(key))], size=256, overlap=128, band=(0.3, 0.6))

    return rnd(_cells(_long(spark, sf_dir), ["t", "sbp", "rri"], kernel, "observed double, edge double, p double, hits long"), "observed", "edge", "p")


@query("spline_grid")
def spline_grid(spark, sf_dir):
    def kernel(key, t, s):
        grid = np.arange(t[0], t[-1], 6.0)
        return list(zip(grid.tolist(), spectral.cubic_spline(t, s, grid, "not-a-knot").tolist(), strict=True))

    return rnd(_cells(_long(spark, sf_dir), ["t", "sbp"], kernel, "at double, value double"), "at", "value", digits=4)


@query("band_pass_correlation")
def band_pass_correlation(spark, sf_dir):
    def kernel(key, t, s, r):
        s, r = (spectral.chebyshev_band(x, 0.08, 0.12) for x in _uniform(t, s, r))
        rho, lag = spectral.sliding_correlation(s, -r, 128, 32)
        return [(int(i), float(a), int(b)) for i, (a, b) in enumerate(zip(rho, lag, strict=True))]

    return rnd(_cells(_long(spark, sf_dir), ["t", "sbp", "rri"], kernel, "window_no int, rho double, lag int"), "rho")


@query("peaks", f"WITH {sql.beats('event_type')}, {sql.peaks(100.0, 5, 'beats', 'subject, phase', 'beat_idx')} SELECT subject, phase, beat_idx AS at, sbp AS height FROM pk")
def peaks(spark, sf_dir):
    def kernel(key, i, s):
        return [(int(i[k]), float(s[k])) for k in spectral.peaks(s, 100.0, 5)]

    return _cells(_long(spark, sf_dir), ["beat_idx", "sbp"], kernel, "at int, height double")


# Autoregression ---------------------------------------------------------------------------------

_VAR = "order int, n_obs int, modulus double, stable boolean, whiteness_p double, normality_p double, f_forward double, p_forward double, f_reverse double, p_reverse double, reason string"


def _var(spark, sf_dir):
    return _cells(_long(spark, sf_dir), ["sbp", "rri"], lambda key, s, r: var.analyse(s, r), _VAR)


@query("var_causality")
def var_causality(spark, sf_dir):
    return rnd(_var(spark, sf_dir), "modulus", "whiteness_p", "normality_p", "f_forward", "p_forward", "f_reverse", "p_reverse")


_ORDERS = f"""{sql.beats('event_type')}, de AS (SELECT subject, phase, beat_idx, sbp - regr_intercept(sbp, beat_idx) OVER w - regr_slope(sbp, beat_idx) OVER w * beat_idx AS s, rri - regr_intercept(rri, beat_idx) OVER w - regr_slope(rri, beat_idx) OVER w * beat_idx AS r FROM beats WINDOW w AS (PARTITION BY subject, phase)),
st AS (SELECT subject, phase, beat_idx, (s - avg(s) OVER w) / stddev_pop(s) OVER w AS s, (r - avg(r) OVER w) / stddev_pop(r) OVER w AS r FROM de WINDOW w AS (PARTITION BY subject, phase)),
se AS (SELECT subject, phase, count(*) AS n, list(s ORDER BY beat_idx) AS s, list(r ORDER BY beat_idx) AS r FROM st GROUP BY ALL HAVING count(*) > 50),
-- Columns of the fit: the constant, the lags one by one, the two responses. Each in turn is taken out of those after it.
q(subject, phase, m, vs, j, ld) AS (SELECT subject, phase, n - 10, list_concat(list_concat([list_transform(range(0, n - 10), lambda i: 1.0::DOUBLE)], flatten(list_transform(range(1, 11), lambda k: [s[11 - k:n - k], r[11 - k:n - k]]))), [s[11:n], r[11:n]]), 0, NULL::DOUBLE FROM se
  UNION ALL SELECT subject, phase, m, ws, j + 1, ln((list_dot_product(ws[-1], ws[-1]) * list_dot_product(ws[-2], ws[-2]) - list_dot_product(ws[-1], ws[-2]) ** 2) / (m * m)) FROM (
    SELECT *, list_transform(range(1, len(vs)), lambda k: list_transform(list_zip(vs[k + 1], vs[1]), lambda z: z[1] - cf[k] * z[2])) AS ws FROM (
      SELECT *, list_transform(vs[2:], lambda v: list_dot_product(v, vs[1]) / list_dot_product(vs[1], vs[1])) AS cf FROM q WHERE j < 21))),
aic AS (SELECT subject, phase, (j - 1) // 2 AS p, ld + 2.0 * (4 * ((j - 1) // 2) + 2) / m AS a FROM q WHERE j >= 3 AND j % 2 = 1),
od AS (SELECT subject, phase, arg_min(p, a)::INTEGER AS "order" FROM aic GROUP BY ALL)"""


@query("var_order_distribution", f"""WITH RECURSIVE {_ORDERS} SELECT g.phase, k.k::INTEGER AS "order", count(od.subject) AS n FROM (VALUES ('Pre'), ('Stim'), ('Post')) AS g(phase), (SELECT unnest(range(1, 11)) AS k) k LEFT JOIN od ON od.phase = g.phase AND od."order" = k.k GROUP BY ALL""")
def var_order_distribution(spark, sf_dir):
    n = _var(spark, sf_dir).groupBy("phase", "order").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([("Pre",), ("Stim",), ("Post",)], "phase string").crossJoin(spark.range(1, 11).select(F.col("id").cast("int").alias("order")))
    return grid.join(n, ["phase", "order"], "left").select("phase", "order", F.coalesce("n", F.lit(0)).alias("n"))


@query("var_diagnostics")
def var_diagnostics(spark, sf_dir):
    g = _var(spark, sf_dir).rollup("phase")
    ok = lambda c: F.count_if(F.col(c) >= 0.05)
    return g.agg(F.count(F.lit(1)).alias("fits"), F.count_if("stable").alias("stable"), F.median("order").alias("median_order"), ok("whiteness_p").alias("white"), ok("normality_p").alias("normal")).withColumn("phase", F.coalesce("phase", F.lit("All")))


# Neighbours -------------------------------------------------------------------------------------

_NL = "direction string, strength double, reduced double, full double, embedding string, n_vectors int, reason string"


def _coupled(method, **options):
    def kernel(key, s, r):
        s, r = nonlinear.standardise(s), nonlinear.standardise(r)
        out = []
        for name, target, source in (("sbp_to_rri", r, s), ("rri_to_sbp", s, r)):
            e = nonlinear.estimate(method, target, source, **options)
            out.append((name, e["strength"], e["reduced"], e["full"], "|".join(e["embedding"]), int(e["n_vectors"]), e["reason"]))
        return out

    return kernel


def _segments(spark, sf_dir):
    return segment.centred(_long(spark, sf_dir), SEGMENT)


for _method in ("LP", "CE", "SSC"):

    @query(f"{_method.lower()}_strength")
    def strength(spark, sf_dir, method=_method):
        return rnd(_cells(_segments(spark, sf_dir), ["sbp", "rri"], _coupled(method), _NL), "strength", "reduced", "full")


for _method in ("LP", "CE", "SSC"):

    @query(f"circular_shift_{_method.lower()}")
    def circular_shift(spark, sf_dir, method=_method):
        """Both directions against 199 shifts, a job a cell, direction and block of shifts."""
        from .analyses import shift_tests

        return rnd(shift_tests(_segments(spark, sf_dir), (method,)), "strength", "edge", "p")


_KPSS = f"""{sql.beats('event_type')}, bh AS (SELECT * REPLACE (t / 3600.0 AS t) FROM beats), {sql.centred(SEGMENT, 'bh', 'rri, sbp')}, lo AS (SELECT subject, phase, i, 'sbp' AS name, sbp AS v FROM seg UNION ALL SELECT subject, phase, i, 'rri', rri FROM seg),
ce AS (SELECT *, v - avg(v) OVER (PARTITION BY subject, phase, name) AS e FROM lo), cs AS (SELECT *, sum(e) OVER (PARTITION BY subject, phase, name ORDER BY i) AS s FROM ce),
li AS (SELECT subject, phase, name, list(e ORDER BY i) AS e, sum(s * s) AS ss, count(*) AS n FROM cs GROUP BY ALL),
ac AS (SELECT *, list_transform(range(0, 128), lambda k: list_dot_product(e[(k + 1):n], e[1:(n - k)]) / n) AS c FROM li),
bw AS (SELECT *, c[1] + 2 * list_sum(c[2:(ceil(pow(n, 2.0 / 9)) + 1)::INTEGER]) AS s0, 2 * list_sum(list_transform(range(1, (ceil(pow(n, 2.0 / 9)) + 1)::BIGINT), lambda j: j * c[j + 1])) AS s1 FROM ac),
wi AS (SELECT *, least(n - 1, floor(1.1447 * pow((s1 / s0) ** 2, 1.0 / 3) * pow(n, 1.0 / 3)))::BIGINT AS width FROM bw),
st AS (SELECT subject, phase, name, ss / (n * n) / (c[1] + 2 * coalesce(list_sum(list_transform(range(1, width + 1), lambda j: (1 - j / (width + 1)) * c[j + 1])), 0.0)) AS stat FROM wi)"""


@query("kpss_flag", f"WITH {_KPSS} SELECT subject, phase, round(max(stat) FILTER (name = 'sbp'), 6) AS sbp_stat, max(stat) FILTER (name = 'sbp') < 0.463 AS sbp_level, round(max(stat) FILTER (name = 'rri'), 6) AS rri_stat, max(stat) FILTER (name = 'rri') < 0.463 AS rri_level FROM st GROUP BY ALL")
def kpss_flag(spark, sf_dir):
    return rnd(_cells(_segments(spark, sf_dir), ["sbp", "rri"], lambda key, s, r: (*nonlinear.kpss(s), *nonlinear.kpss(r)), "sbp_stat double, sbp_level boolean, rri_stat double, rri_level boolean"), "sbp_stat", "rri_stat")


_KPSS_P = "CASE WHEN {0} <= 0.347 THEN 0.1 WHEN {0} <= 0.463 THEN 0.1 - 0.05 * ({0} - 0.347) / 0.116 WHEN {0} <= 0.574 THEN 0.05 - 0.025 * ({0} - 0.463) / 0.111 WHEN {0} <= 0.739 THEN 0.025 - 0.015 * ({0} - 0.574) / 0.165 ELSE 0.01 END"


@query(
    "primary_qc",
    f"WITH {_KPSS}, sg AS (SELECT subject, phase, count(*) AS n_selected, avg(sbp) AS mean_sbp, avg(rri) AS mean_rri, stddev_samp(sbp) AS sd_sbp, stddev_samp(rri) AS sd_rri FROM seg GROUP BY ALL), kp AS (SELECT subject, phase, max({_KPSS_P.format('stat')}) FILTER (name = 'rri') AS rri_p, max({_KPSS_P.format('stat')}) FILTER (name = 'sbp') AS sbp_p FROM st GROUP BY ALL) SELECT subject, phase, n_selected, {R('mean_sbp mean_rri sd_sbp sd_rri rri_p sbp_p')}, CASE WHEN rri_p < 0.05 AND sbp_p < 0.05 THEN 'FLAG_RRI_AND_SBP' WHEN rri_p < 0.05 THEN 'FLAG_RRI' WHEN sbp_p < 0.05 THEN 'FLAG_SBP' ELSE 'PASS_BOTH' END AS flag FROM sg JOIN kp USING (subject, phase)",
)
def primary_qc(spark, sf_dir):
    def kernel(key, s, r):
        flag, rri_p, sbp_p = nonlinear.stationarity(nonlinear.kpss(r)[0], nonlinear.kpss(s)[0])
        return len(s), s.mean(), r.mean(), s.std(ddof=1), r.std(ddof=1), rri_p, sbp_p, flag

    values = "mean_sbp mean_rri sd_sbp sd_rri rri_p sbp_p".split()
    return rnd(_cells(_segments(spark, sf_dir), ["sbp", "rri"], kernel, "n_selected long, " + ", ".join(f"{v} double" for v in values) + ", flag string"), *values)


_EMBED = "e AS (SELECT subject, phase, beat_idx, sbp AS y, lag(sbp, 1) OVER w AS x1, lag(sbp, 2) OVER w AS x2 FROM beats WINDOW w AS (PARTITION BY subject, phase ORDER BY beat_idx))"


@query(
    "knn_chebyshev_k",
    f"WITH {sql.beats()}, {_EMBED}, p AS (SELECT a.subject, a.phase, a.beat_idx, b.beat_idx AS other, greatest(abs(a.x1 - b.x1), abs(a.x2 - b.x2)) AS distance FROM e a JOIN e b ON a.subject = b.subject AND a.phase = b.phase AND abs(a.beat_idx - b.beat_idx) > 2 WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL), k AS (SELECT *, (row_number() OVER (PARTITION BY subject, phase, beat_idx ORDER BY distance, other))::INTEGER AS place FROM p) SELECT subject, phase, beat_idx, other, {R('distance', 9)}, place FROM k WHERE place <= 3",
)
def knn_chebyshev_k(spark, sf_dir):
    def kernel(key, i, y):
        if len(y) < 3:
            return []
        past, at = (y[1:-1], y[:-2]), i[2:]
        near, far, ok = nonlinear.nearest_there(past, 3, 2)
        rows, place = np.nonzero(ok)
        return [(int(at[r]), int(at[near[r, p]]), float(far[r, p]), int(p) + 1) for r, p in zip(rows, place, strict=True)]

    return rnd(_cells(beats(spark, sf_dir), ["beat_idx", "sbp"], kernel, "beat_idx int, other int, distance double, place int"), "distance", digits=9)


@query("corr_probability", f"WITH {sql.beats()}, g AS (SELECT a.subject, a.phase, count(*) AS pairs, avg((abs(a.sbp - b.sbp) < 10)::INTEGER) AS probability FROM beats a JOIN beats b ON a.subject = b.subject AND a.phase = b.phase AND a.beat_idx < b.beat_idx GROUP BY ALL) SELECT subject, phase, pairs, {R('probability')} FROM g")
def corr_probability(spark, sf_dir):
    def kernel(key, v):
        return (len(v) * (len(v) - 1) // 2, nonlinear.pair_probability(v, 10.0))

    return rnd(_cells(beats(spark, sf_dir), ["sbp"], kernel, "pairs long, probability double").where("pairs > 0"), "probability")


# Small models -----------------------------------------------------------------------------------


def _participants(spark, sf_dir):
    """One row per subject: differences of pressure, interval and length between Stim and Pre."""
    m = beats(spark, sf_dir).groupBy(*CELL).agg(F.avg("sbp").alias("sbp"), F.avg("rri").alias("rri"), F.count(F.lit(1)).cast("double").alias("size"))
    w = m.groupBy("subject").pivot("phase", ["Pre", "Stim"]).agg(F.first("sbp").alias("sbp"), F.first("rri").alias("rri"), F.first("size").alias("size")).dropna()
    return w.select(F.lit("all").alias("cohort"), "subject", *[(F.col(f"Stim_{c}") - F.col(f"Pre_{c}")).alias(c) for c in ("sbp", "rri", "size")])


def _cohort(spark, sf_dir, values, kernel, schema):
    return per_group(_participants(spark, sf_dir), ["cohort"], ["subject"], values, kernel, schema)


def _model(spark, sf_dir):
    return linear.fit(_participants(spark, sf_dir), ["cohort"], "sbp", ["rri", "size"])


@query("ols_hc3", f"WITH {sql.beats()}, {sql.OLS}, t AS (SELECT term, b, hc3, beta, n - 3 AS v, abs(b / hc3) AS t FROM coef) SELECT 'all' AS cohort, term, {R('b hc3 beta')}, {R(sql.t_tail('t', 'v') + ' AS p')} FROM t")
def ols_hc3(spark, sf_dir):
    return rnd(linear.coefficients(_model(spark, sf_dir)).select("cohort", "term", "b", "hc3", "p", "beta"), "b", "hc3", "p", "beta")


@query(
    "residual_diagnostics",
    f"""WITH {sql.beats()}, {sql.OLS}, j AS (SELECT avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4, any_value(n) AS n, sum(e * e * e * e) - sum(e * e) * sum(e * e) / any_value(n) AS spread FROM res),
  jb AS (SELECT n / 6.0 * (m3 / pow(m2, 1.5)) ** 2 + n / 24.0 * (m4 / (m2 * m2) - 3) ** 2 AS q FROM j),
  aux AS (SELECT regr_count(e * e, x1) AS n, covar_pop(x1, e * e) AS c1, covar_pop(x2, e * e) AS c2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, var_pop(e * e) AS vu FROM res),
  bp AS (SELECT n * ((c1 * c1 * v2 - 2 * c1 * c2 * v12 + c2 * c2 * v1) / (v1 * v2 - v12 * v12)) / vu AS q FROM aux),
  dw AS (SELECT sum(d * d) / sum(e * e) AS q FROM (SELECT e, e - lag(e) OVER (ORDER BY subject) AS d FROM res))
SELECT 'all' AS cohort, 'jarque_bera' AS test, round(q, 6) AS statistic, round(exp(-q / 2), 6) AS p FROM jb
UNION ALL SELECT 'all', 'breusch_pagan', round(q, 6), round(exp(-q / 2), 6) FROM bp UNION ALL SELECT 'all', 'durbin_watson', round(q, 6), NULL FROM dw""",
)
def residual_diagnostics(spark, sf_dir):
    return rnd(linear.residual_tests(_model(spark, sf_dir), "subject"), "statistic", "p")


@query("residual_shapiro")
def residual_shapiro(spark, sf_dir):
    kernel = lambda key, e: tuple(map(float, regression.shapiro_wilk(e)))
    return rnd(per_group(_model(spark, sf_dir).rows, ["cohort"], ["subject"], ["residual"], kernel, "statistic double, p double"), "statistic", "p")


@query("influence", f"WITH {sql.beats()}, {sql.OLS}, k AS (SELECT *, row_number() OVER (ORDER BY round(cook, 9) DESC, subject) AS place FROM infl) SELECT 'all' AS cohort, subject, {R('leverage cook')}, cook > 4.0 / n AS large, {R('dfb_constant dfb_rri dfb_size')} FROM k WHERE place <= 3")
def influence(spark, sf_dir):
    rows = _model(spark, sf_dir).rows.orderBy(F.round("cook", 9).desc(), "subject").limit(3)
    return rnd(rows.select("cohort", "subject", "leverage", "cook", "large", "dfb_constant", "dfb_rri", "dfb_size"), "leverage", "cook", "dfb_constant", "dfb_rri", "dfb_size")


_ROWS_OF_MODEL = "m0 AS (SELECT subject, slope AS y, phase = 'Stim' AS x FROM seqq WHERE qualifies AND phase IN ('Pre', 'Stim')), ce AS (SELECT avg(y) AS c FROM m0), ps AS (SELECT subject, count(*) AS n, count(*) FILTER (x) AS n_x, sum(y - c) AS sum_y, coalesce(sum(y - c) FILTER (x), 0.0) AS sum_xy, sum((y - c) * (y - c)) AS sum_yy FROM m0, ce GROUP BY subject)"
_GATE_OF_MODEL = "gt AS (SELECT count(*) AS participants, sum(n)::BIGINT AS rows, min(least(n_x, n - n_x)) AS least_rows, min(least(n_x, n - n_x)) >= 2 AS eligible FROM ps)"


def _model_rows(spark, sf_dir, key):
    """Qualifying sequences of Pre and Stim; x says Stim."""
    found = ramps.sequences(beats(spark, sf_dir, key), (CANONICAL,), tasks=tasks(spark, sf_dir, key)).where("qualifies and phase in ('Pre', 'Stim')")
    return found.select(F.lit("all").alias("cohort"), "subject", "slope", (F.col("phase") == "Stim").alias("x"))


@query("mixed_model_sums", f"WITH {sql.sequences((CANONICAL,))}, {_ROWS_OF_MODEL}, {_GATE_OF_MODEL} SELECT subject, n, n_x, {R('sum_y sum_xy sum_yy')}, participants, rows, least_rows, eligible FROM ps, gt")
def mixed_model_sums(spark, sf_dir):
    """Participants' sums, and the gate of all of them."""
    sums = mixed.participant_sums(_model_rows(spark, sf_dir, "user_id"), "slope", "x", "cohort")
    out = sums.crossJoin(F.broadcast(mixed.eligibility(sums, "cohort").drop("cohort")))
    return rnd(out.select("subject", "n", "n_x", "sum_y", "sum_xy", "sum_yy", "participants", "rows", "least_rows", "eligible"), "sum_y", "sum_xy", "sum_yy")


def _solved(r: str, source: str, name: str) -> str:
    """CTE body: the profile at ratio ``r`` of every row of ``source``, with columns prefixed by ``name``."""
    w = lambda f: f"list_sum(list_transform(range(1, len(n) + 1), lambda i: {r} / (1 + {r} * n[i]) * {f}))"
    made = {"a11": f"rw - {w('n[i] * n[i] * g[i]')}", "a12": f"sx - {w('n[i] * x[i]')}", "a22": f"sx - {w('xx[i]')}", "c1": f"sy - {w('n[i] * y[i]')}", "c2": f"exy - {w('xy[i]')}", "q": f"eyy - {w('yy[i]')}", "ld": f"list_sum(list_transform(range(1, len(n) + 1), lambda i: g[i] * ln(1 + {r} * n[i])))"}
    det = f"({name}a11 * {name}a22 - {name}a12 * {name}a12)"
    rss = f"({name}q - ({name}a22 * {name}c1 * {name}c1 - 2 * {name}a12 * {name}c1 * {name}c2 + {name}a11 * {name}c2 * {name}c2) / {det})"
    return f"SELECT *, {rss} / (rw - 2) AS {name}s2, (rw - 2) * ln({rss} / (rw - 2)) + {name}ld + ln({det}) AS {name}loss FROM (SELECT *, {', '.join(f'{v} AS {name}{k}' for k, v in made.items())} FROM ({source}))"


_G = (math.sqrt(5) - 1) / 2
_FIT_OF_MODEL = f"""nt AS (SELECT n::DOUBLE AS n, count(*)::DOUBLE AS g, sum(n_x)::DOUBLE AS x, sum(n_x * n_x)::DOUBLE AS xx, sum(sum_y) AS y, sum(sum_y * sum_y) AS yy, sum(n_x * sum_y) AS xy, sum(sum_yy) AS eyy, sum(sum_xy) AS exy FROM ps GROUP BY 1),
ar AS (SELECT list(n ORDER BY n) AS n, list(g ORDER BY n) AS g, list(x ORDER BY n) AS x, list(xx ORDER BY n) AS xx, list(y ORDER BY n) AS y, list(yy ORDER BY n) AS yy, list(xy ORDER BY n) AS xy, sum(n * g) AS rw, sum(x) AS sx, sum(y) AS sy, sum(eyy) AS eyy, sum(exy) AS exy FROM nt),
gold(lo, hi, step) AS (SELECT -12.0::DOUBLE, 8.0::DOUBLE, 0 UNION ALL SELECT CASE WHEN c_loss < d_loss THEN lo ELSE c END, CASE WHEN c_loss < d_loss THEN d ELSE hi END, step + 1 FROM ({_solved('exp(d)', _solved('exp(c)', f'SELECT *, hi - {_G!r} * (hi - lo) AS c, lo + {_G!r} * (hi - lo) AS d FROM gold, ar WHERE step < 80', 'c_'), 'd_')})),
top AS (SELECT CASE WHEN z_loss <= t_loss THEN 0.0 ELSE r END AS ratio FROM ({_solved('0.0', _solved('r', 'SELECT exp((lo + hi) / 2) AS r, ar.* FROM gold, ar WHERE step = 80', 't_'), 'z_')})),
fit AS (SELECT *, f_a11 * f_a22 - f_a12 * f_a12 AS det FROM ({_solved('ratio', 'SELECT ratio, ar.* FROM top, ar', 'f_')})),
co AS (SELECT 'constant' AS term, (f_a22 * f_c1 - f_a12 * f_c2) / det + (SELECT c FROM ce) AS b, sqrt(f_s2 * f_a22 / det) AS se, fit.* FROM fit UNION ALL SELECT 'effect', (f_a11 * f_c2 - f_a12 * f_c1) / det, sqrt(f_s2 * f_a11 / det), fit.* FROM fit),
cz AS (SELECT *, b / se AS z, ratio * f_s2 AS group_variance, f_s2 AS residual_variance, -0.5 * (f_loss + (rw - 2) * (1 + ln(2 * pi()))) AS log_likelihood, sqrt((rw + sx + sqrt((rw + sx) ** 2 - 4 * (rw * sx - sx * sx))) / (rw + sx - sqrt((rw + sx) ** 2 - 4 * (rw * sx - sx * sx)))) AS condition FROM co)"""


def _signed(df, *columns, digits):
    """As ``rnd``; what is below 0 and rounds to it keeps its sign, as in SQL."""
    below = {c: -F.round(-F.when(F.col(c) < 0, F.col(c)), digits) for c in columns}
    return df.withColumns({c: F.coalesce(below[c], F.round(F.when(~F.isnan(c), F.col(c)), digits)) for c in columns})


@query(
    "mixed_model",
    f"""WITH RECURSIVE {sql.sequences((CANONICAL,), 'event_type')}, {_ROWS_OF_MODEL}, {_GATE_OF_MODEL}, {_FIT_OF_MODEL}
SELECT term, participants, gt.rows, least_rows, eligible, {R('b se z group_variance residual_variance log_likelihood condition', 4)}, {R(sql.normal_tail('z') + ' AS p', 4)}, ratio * f_s2 <= 1e-8 OR ratio <= 1e-8 AS singular, CASE WHEN ratio * f_s2 <= 1e-8 OR ratio <= 1e-8 THEN 'not_estimable' ELSE 'estimable' END AS status, CASE WHEN ratio * f_s2 <= 1e-8 OR ratio <= 1e-8 THEN 'nonconvergence_or_singular_random_intercept' ELSE 'NA' END AS reason FROM gt, cz WHERE eligible
UNION ALL SELECT NULL, participants, rows, least_rows, eligible, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not_estimable', 'eligibility_gate_failed' FROM gt WHERE NOT eligible""",
)
def mixed_model(spark, sf_dir):
    """Event types are the participants here: each has many sequences in both phases, as the gate wants."""
    out = mixed.random_intercept(_model_rows(spark, sf_dir, "event_type"), "slope", "x", "cohort")
    values = ("b", "se", "z", "group_variance", "residual_variance", "log_likelihood", "condition", "p")
    return _signed(out.select("term", "participants", "rows", "least_rows", "eligible", *values, "singular", "status", "reason"), *values, digits=4)


@query(
    "jzs_bayes_factor",
    f"""WITH {sql.pairs((CANONICAL,))}, j AS (SELECT contrast, count(*) AS n, avg(d) / (nullif(stddev_samp(d), 0) / sqrt(count(*))) AS t FROM pair GROUP BY contrast),
q AS (SELECT *, n - 1 AS v, list_transform(range(0, 8001), lambda i: exp(-20 + i * 0.005)) AS g FROM j),
f AS (SELECT *, list_transform(g, lambda x: pow(1 + n * 0.5 * x, -0.5) * pow(1 + t * t / ((1 + n * 0.5 * x) * v), -(v + 1) / 2.0) * pow(2 * pi(), -0.5) * pow(x, -1.5) * exp(-1 / (2 * x)) * x) AS y FROM q),
b AS (SELECT contrast, n, t, 0.005 * (list_sum(y) - (y[1] + y[8001]) / 2) / pow(1 + t * t / v, -(v + 1) / 2.0) AS bf10 FROM f) SELECT contrast, n, {R('t bf10')} FROM b""",
)
def jzs_bayes_factor(spark, sf_dir):
    g = ramps.gains(beats(spark, sf_dir), (CANONICAL,)).where("direction = 'all'").select("setting", *CELL, "gain")

    def kernel(key, d):
        t = float(d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))) if len(d) > 1 and d.std(ddof=1) > 0 else math.nan
        return len(d), t, regression.jzs_bayes_factor(t, len(d)) if math.isfinite(t) else math.nan

    return rnd(per_group(contrasts.differences(g, "gain"), ["contrast"], ["subject"], ["d"], kernel, "n int, t double, bf10 double"), "t", "bf10")


@query("resampled_association")
def resampled_association(spark, sf_dir):
    analyses = tuple(resampling.Analysis(*a) for a in (("pearson", 10_000), ("permutation", 100_000), ("theil_sen", 10_000)))
    out = resampling.paired(_participants(spark, sf_dir), ["cohort"], "subject", "sbp", "rri", analyses, 20260801)
    method = F.when(F.col("analysis") == "permutation", "spearman").otherwise(F.col("analysis")).alias("method")
    return rnd(out.select("cohort", method, "estimate", "low", "high", "p"), "estimate", "low", "high", "p")


@query("coupling_sensitivity")
def coupling_sensitivity(spark, sf_dir):
    from .analyses import coupling_sensitivity as sweep

    return rnd(sweep(_long(spark, sf_dir))["effects"], "mean_first", "mean_second", "mean_difference", "median_difference", "dz")
