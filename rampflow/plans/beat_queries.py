"""Queries on beat series made of the event table: segments, ramps, gains, contrasts and their tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import average_rank, slope, stable_seed, text_array, with_bh
from ..operators import audit, context, contrasts, joins, pairing, prevalence, ramps, scans, segment, summaries, waves
from ..schema import BRANCHES, CANONICAL, CELL, FACTORIAL, OFAT, PHASES
from ..sources.beats import event_beats, tasks_of
from . import sql
from .registry import query

R = sql.rounded


def beats(spark: SparkSession, sf_dir: str, key: str = "user_id") -> DataFrame:
    return event_beats(spark.read.parquet(f"{sf_dir}/events.parquet"), key)


def tasks(spark: SparkSession, sf_dir: str, key: str) -> int:
    """Tasks over which the few long cells of event types are dealt; 0 for the many short ones of users, and for a small table."""
    return tasks_of(spark.read.parquet(f"{sf_dir}/events.parquet")) if key == "event_type" else 0


def rnd(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), digits) for c in columns})


# Segments ---------------------------------------------------------------------------------------


@query("phase_filter_counts", f"WITH {sql.beats()} SELECT subject, phase, count(*) AS n_rows, count(*) AS n_valid, 0::BIGINT AS n_missing, min(beat_idx) AS first_row, max(beat_idx) AS last_row FROM beats GROUP BY ALL")
def phase_filter_counts(spark, sf_dir):
    return segment.phase_counts(beats(spark, sf_dir))


# Four weeks of January 2024, in seconds.
_DAYS = "(VALUES ('w1', 1704067200.0, 1704672000.0, 0), ('w2', 1704672000.0, 1705276800.0, 1), ('w3', 1705276800.0, 1705881600.0, 2), ('w4', 1705881600.0, 1706486400.0, 3))"


@query("window_range_join", f'WITH {sql.beats()} SELECT "window", n, {R("mean_sbp")} FROM (SELECT w."window", count(*) AS n, avg(b.sbp) AS mean_sbp FROM beats b JOIN {_DAYS} AS w("window", lo, hi, ord) ON b.t >= lo AND b.t < hi GROUP BY 1) w')
def window_range_join(spark, sf_dir):
    w = spark.createDataFrame([(f"w{i + 1}", 1704067200.0 + 604800.0 * i, 1704672000.0 + 604800.0 * i, i) for i in range(4)], "window string, lo double, hi double, ord int")
    return rnd(segment.in_windows(beats(spark, sf_dir), w).groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.avg("sbp").alias("mean_sbp")), "mean_sbp")


@query(
    "context_metrics",
    f"""WITH {sql.beats()}, d AS (SELECT *, rri - lag(rri) OVER (PARTITION BY subject, phase ORDER BY beat_idx) AS dd FROM beats), g AS (
  SELECT subject, phase, count(*) AS n_beats, max(t) - min(t) AS duration, avg(rri) AS mean_rri, avg(60000.0 / rri) AS mean_hr, avg(sbp) AS mean_sbp,
         stddev_samp(rri) AS sd_rri, stddev_samp(sbp) AS sd_sbp, sqrt(avg(dd * dd)) AS rmssd FROM d GROUP BY ALL)
SELECT subject, phase, n_beats, {R("duration", 5)}, {R("mean_rri mean_sbp sd_rri sd_sbp rmssd", 9)}, round(ln(mean_hr), 7) AS mean_hr FROM g""",
)
def context_metrics(spark, sf_dir):
    # Rates of gaps of seconds and days differ by many powers of ten: compared by their logarithm.
    out = context.context(beats(spark, sf_dir)).withColumn("mean_hr", F.round(F.ln("mean_hr"), 7))
    return rnd(rnd(out, "duration", digits=5), "mean_rri", "mean_sbp", "sd_rri", "sd_sbp", "rmssd", digits=9)


@query(
    "phase_descriptives",
    f"""WITH {sql.beats()}, u AS (SELECT phase, 'rri' AS metric, rri AS v FROM beats UNION ALL SELECT phase, 'sbp', sbp FROM beats), g AS (
  SELECT metric, phase, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd, median(v) AS median, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM u GROUP BY ALL)
SELECT metric, phase, n, {R("mean sd median q1 q3")}, round(q3 - q1, 6) AS iqr FROM g""",
)
def phase_descriptives(spark, sf_dir):
    long = beats(spark, sf_dir).unpivot(["phase"], ["rri", "sbp"], "metric", "v")
    return rnd(context.descriptives(long, "v", "metric", "phase"), "mean", "sd", "median", "q1", "q3", "iqr")


@query(
    "trajectory_bins",
    f"""WITH RECURSIVE {sql.beats("event_type")}, s AS (SELECT subject, floor(t / 86400)::BIGINT AS bin, avg(sbp) AS v FROM beats GROUP BY ALL), g AS (
  SELECT bin, count(v) AS n, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS sem FROM s GROUP BY bin),
bis(n, a, b, step) AS (SELECT DISTINCT n, 0.0::DOUBLE, 1000.0::DOUBLE, 0 FROM g WHERE n > 1 UNION ALL SELECT n, CASE WHEN far THEN (a + b) / 2 ELSE a END, CASE WHEN far THEN b ELSE (a + b) / 2 END, step + 1
  FROM (SELECT *, {sql.t_tail("((a + b) / 2)", "(n - 1)")} > 0.05 AS far FROM bis WHERE step < 60)), q AS (
  SELECT g.*, mean - a * sem AS ci_low, mean + a * sem AS ci_high FROM g LEFT JOIN (SELECT n, a FROM bis WHERE step = 60) t ON t.n = g.n)
SELECT bin, n, {R("mean sem ci_low ci_high")} FROM q""",
)
def trajectory_bins(spark, sf_dir):
    return rnd(context.trajectory(segment.binned(beats(spark, sf_dir, "event_type"), 86400.0), "sbp"), "mean", "sem", "ci_low", "ci_high")


for _k in (0, 1, 2):

    @query(f"lag_align_{_k}", f"WITH {sql.beats()}, a AS (SELECT subject, phase, beat_idx, {_k} AS lag, sbp, lead(rri, {_k}) OVER w AS rri, lead(beat_idx, {_k}) OVER w AS nx FROM beats WINDOW w AS (PARTITION BY subject, phase ORDER BY beat_idx)) SELECT subject, phase, beat_idx, sbp, lag, rri FROM a WHERE nx IS NOT NULL")
    def lag_align(spark, sf_dir, k=_k):
        return ramps.aligned(beats(spark, sf_dir), [k])


@query("first_differences", f"WITH {sql.beats()}, d AS (SELECT subject, phase, beat_idx, sbp - lag(sbp) OVER (PARTITION BY subject, phase ORDER BY beat_idx) AS step FROM beats) SELECT subject, phase, beat_idx, {R('step', 9)} FROM d WHERE step IS NOT NULL")
def first_differences(spark, sf_dir):
    return rnd(segment.differences(beats(spark, sf_dir), "sbp").select("subject", "phase", "beat_idx", "step"), "step", digits=9)


@query(
    "centered_segment",
    f"""WITH {sql.beats()}, a AS (SELECT *, row_number() OVER w AS n, lead(t, 7) OVER w AS e, (min(t) OVER (PARTITION BY subject, phase) + max(t) OVER (PARTITION BY subject, phase)) / 2 AS mid
  FROM beats WINDOW w AS (PARTITION BY subject, phase ORDER BY beat_idx)), b AS (SELECT *, row_number() OVER (PARTITION BY subject, phase ORDER BY abs((t + e) / 2 - mid), n) AS k FROM a WHERE e IS NOT NULL), c AS (SELECT subject, phase, n FROM b WHERE k = 1)
SELECT a.subject, a.phase, a.beat_idx FROM a JOIN c ON a.subject = c.subject AND a.phase = c.phase WHERE a.n BETWEEN c.n AND c.n + 7""",
)
def centered_segment(spark, sf_dir):
    return segment.centred(beats(spark, sf_dir), 8).select("subject", "phase", "beat_idx")


@query(
    "detrend_zscore",
    f"""WITH {sql.beats("event_type")}, g AS (SELECT subject, phase, regr_slope(sbp, beat_idx) AS b, regr_intercept(sbp, beat_idx) AS a FROM beats GROUP BY ALL), d AS (
  SELECT b.subject, b.phase, b.beat_idx, b.sbp - g.a - g.b * b.beat_idx AS v FROM beats b JOIN g USING (subject, phase)), z AS (
  SELECT subject, phase, beat_idx, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z FROM d WINDOW w AS (PARTITION BY subject, phase))
SELECT subject, phase, beat_idx, {R("z")} FROM z""",
)
def detrend_zscore(spark, sf_dir):
    return rnd(segment.detrended(beats(spark, sf_dir, "event_type"), "sbp", 1).select("subject", "phase", "beat_idx", "z"), "z")


@query(
    "lag_design_ols",
    f"""WITH {sql.beats()}, l AS (SELECT subject, phase, sbp, lag(sbp, 1) OVER w AS lag1, lag(sbp, 2) OVER w AS lag2 FROM beats WINDOW w AS (PARTITION BY subject, phase ORDER BY beat_idx)), g AS (
  SELECT subject, phase, count(*) AS n, covar_pop(sbp, lag1) / nullif(var_pop(lag1), 0) AS slope1, covar_pop(sbp, lag2) / nullif(var_pop(lag2), 0) AS slope2 FROM l WHERE lag2 IS NOT NULL GROUP BY ALL)
SELECT subject, phase, n, {R("slope1 slope2")} FROM g""",
)
def lag_design_ols(spark, sf_dir):
    rows = segment.lagged(beats(spark, sf_dir), "sbp", 2)
    return rnd(rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), slope("sbp", "lag1").alias("slope1"), slope("sbp", "lag2").alias("slope2")), "slope1", "slope2")


@query("welch_segments", f"WITH {sql.beats('event_type')}, g AS (SELECT subject, phase, count(*) AS n FROM beats GROUP BY ALL) SELECT subject, phase, n, CASE WHEN n < 128 THEN 0 ELSE 1 + (n - 128) // 64 END::BIGINT AS segments FROM g")
def welch_segments(spark, sf_dir):
    n = beats(spark, sf_dir, "event_type").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("segments", F.when(F.col("n") < 128, 0).otherwise(1 + F.floor((F.col("n") - 128) / 64)).cast("long"))


# Ramps and gains --------------------------------------------------------------------------------

_RAMP = "SELECT subject, phase, direction, start_idx, end_idx, n_beats, ramp_index FROM seqq"


def _ramp_table(spark, sf_dir, setting):
    return ramps.sequences(beats(spark, sf_dir), (setting,)).select("subject", "phase", "direction", "start_idx", "end_idx", "n_beats", "ramp_index")


@query("ramps_up_down", f"WITH {sql.sequences((CANONICAL,))} {_RAMP}")
def ramps_up_down(spark, sf_dir):
    return _ramp_table(spark, sf_dir, CANONICAL)


@query("ramps_strict", f"WITH {sql.sequences((BRANCHES[1],))} {_RAMP}")
def ramps_strict(spark, sf_dir):
    return _ramp_table(spark, sf_dir, BRANCHES[1])


@query("overlap_subramps", f"WITH {sql.sequences((BRANCHES[3],))} {_RAMP}")
def overlap_subramps(spark, sf_dir):
    return _ramp_table(spark, sf_dir, BRANCHES[3])


@query("sequence_table", f"WITH {sql.sequences(BRANCHES[:3])} SELECT setting, subject, phase, direction, ramp_index, start_idx, end_idx, n_beats, sbp_start, sbp_end, {R('rri_start rri_end r slope')}, rri_monotone, rri_concordant_1ms, qualifies FROM seqq")
def sequence_table(spark, sf_dir):
    found = ramps.sequences(beats(spark, sf_dir), BRANCHES[:3])
    cols = "setting subject phase direction ramp_index start_idx end_idx n_beats sbp_start sbp_end rri_start rri_end r slope rri_monotone rri_concordant_1ms qualifies".split()
    return rnd(found.select(*cols), "rri_start", "rri_end", "r", "slope")


_GAIN = f"SELECT setting, subject, phase, direction, n_ramps, n_maximal, n_sequences, {R('bei gain')}, reason FROM gain"


def _gain_table(spark, sf_dir, settings, *more):
    cols = ["setting", "subject", "phase", "direction", "n_ramps", "n_maximal", "n_sequences", "bei", "gain", "reason", *more]
    return rnd(ramps.gains(beats(spark, sf_dir), settings).select(*cols), "bei", "gain", *more)


@query("brs_canonical", f"WITH {sql.gains((CANONICAL,))} {_GAIN}")
def brs_canonical(spark, sf_dir):
    return _gain_table(spark, sf_dir, (CANONICAL,))


@query("brs_branches", f"WITH {sql.gains(BRANCHES)} {_GAIN}")
def brs_branches(spark, sf_dir):
    return _gain_table(spark, sf_dir, BRANCHES)


@query("brs_ofat", f"WITH {sql.gains(OFAT)} {_GAIN}")
def brs_ofat(spark, sf_dir):
    return _gain_table(spark, sf_dir, OFAT)


@query("brs_full_factorial", f"WITH {sql.gains(FACTORIAL, 'event_type')} {_GAIN}")
def brs_full_factorial(spark, sf_dir):
    cols = ["setting", "subject", "phase", "direction", "n_ramps", "n_maximal", "n_sequences", "bei", "gain", "reason"]
    return rnd(ramps.gains(beats(spark, sf_dir, "event_type"), FACTORIAL, tasks=tasks(spark, sf_dir, "event_type")).select(*cols), "bei", "gain")


@query("sequence_quality", f"WITH {sql.gains(BRANCHES)} SELECT setting, subject, phase, direction, {R('mean_beats mean_r mean_r2 mean_sbp_amplitude mean_rri_response')} FROM gain")
def sequence_quality(spark, sf_dir):
    cols = ["mean_beats", "mean_r", "mean_r2", "mean_sbp_amplitude", "mean_rri_response"]
    return rnd(ramps.gains(beats(spark, sf_dir), BRANCHES).select("setting", "subject", "phase", "direction", *cols), *cols)


@query("na_reasons", f"WITH {sql.gains(BRANCHES)} SELECT setting, direction, reason, count(*) AS n FROM gain GROUP BY ALL")
def na_reasons(spark, sf_dir):
    return ramps.gains(beats(spark, sf_dir), BRANCHES).groupBy("setting", "direction", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "evaluability",
    f"WITH {sql.gains(BRANCHES)}, g AS (SELECT setting, phase, direction, count(gain) AS n_evaluable, avg((gain IS NOT NULL)::INTEGER) AS share, median(n_sequences) AS median_sequences, min(n_sequences) AS least_sequences FROM gain GROUP BY ALL) SELECT setting, phase, direction, n_evaluable, {R('share median_sequences')}, least_sequences FROM g",
)
def evaluability(spark, sf_dir):
    g = ramps.gains(beats(spark, sf_dir), BRANCHES).groupBy("setting", "phase", "direction")
    return rnd(g.agg(F.count("gain").alias("n_evaluable"), F.avg(F.col("gain").isNotNull().cast("int")).alias("share"), F.median("n_sequences").alias("median_sequences"), F.min("n_sequences").alias("least_sequences")), "share", "median_sequences")


# Contrasts --------------------------------------------------------------------------------------

_SUMMARY = """s AS (SELECT setting, contrast, count(d) AS n, avg(first) AS mean_first, avg(second) AS mean_second, avg(d) AS mean_difference, median(d) AS median_difference,
  avg(d) / nullif(stddev_samp(d), 0) AS dz, count(*) FILTER (d < 0) AS n_negative, count(*) FILTER (d > 0) AS n_positive, count(*) FILTER (d = 0) AS n_zero FROM pair GROUP BY ALL)"""


def _pairs(spark, sf_dir, settings, key="user_id"):
    g = ramps.gains(beats(spark, sf_dir, key), settings, tasks=tasks(spark, sf_dir, key)).where("direction = 'all'").select("setting", *CELL, "gain")
    return contrasts.differences(g, "gain", "setting")


@query("paired_contrasts", f"WITH {sql.pairs(OFAT)}, {_SUMMARY} SELECT setting, contrast, n, {R('mean_first mean_second mean_difference median_difference dz')}, n_negative, n_positive, n_zero FROM s")
def paired_contrasts(spark, sf_dir):
    return rnd(contrasts.summary(_pairs(spark, sf_dir, OFAT), "setting", "contrast"), "mean_first", "mean_second", "mean_difference", "median_difference", "dz")


@query(
    "specification_curve",
    f"WITH {sql.pairs(FACTORIAL, 'event_type')}, {_SUMMARY}, k AS (SELECT setting, n, round(mean_difference, 6) AS mean_difference FROM s WHERE contrast = 'Stim-Pre') SELECT setting, n, mean_difference, (row_number() OVER (ORDER BY mean_difference NULLS LAST, setting))::INTEGER AS place FROM k",
)
def specification_curve(spark, sf_dir):
    s = contrasts.summary(_pairs(spark, sf_dir, FACTORIAL, "event_type"), "setting", "contrast").where("contrast = 'Stim-Pre'")
    s = rnd(s.select("setting", "n", "mean_difference"), "mean_difference")
    return scans.places(s, "mean_difference", "setting")


@query(
    "factorial_summary",
    f"WITH {sql.pairs(FACTORIAL, 'event_type')}, {_SUMMARY}, g AS (SELECT contrast, count(*) AS n_settings, min(dz) AS least_dz, median(dz) AS median_dz, max(dz) AS most_dz, avg((mean_difference < 0)::INTEGER) AS negative_share FROM s GROUP BY contrast) SELECT contrast, n_settings, {R('least_dz median_dz most_dz negative_share')} FROM g",
)
def factorial_summary(spark, sf_dir):
    s = contrasts.summary(_pairs(spark, sf_dir, FACTORIAL, "event_type"), "setting", "contrast").groupBy("contrast")
    out = s.agg(F.count(F.lit(1)).alias("n_settings"), F.min("dz").alias("least_dz"), F.median("dz").alias("median_dz"), F.max("dz").alias("most_dz"), F.avg((F.col("mean_difference") < 0).cast("int")).alias("negative_share"))
    return rnd(out, "least_dz", "median_dz", "most_dz", "negative_share")


@query(
    "loo_contrasts",
    f"WITH {sql.pairs((CANONICAL,))}, g AS (SELECT a.contrast, a.subject AS omitted, count(b.d) AS n, avg(b.d) AS mean, median(b.d) AS median, avg(b.d) / nullif(stddev_samp(b.d), 0) AS dz FROM pair a JOIN pair b ON a.contrast = b.contrast AND a.subject <> b.subject GROUP BY ALL) SELECT contrast, omitted, n, {R('mean median dz')} FROM g",
)
def loo_contrasts(spark, sf_dir):
    return rnd(contrasts.leave_one_out(_pairs(spark, sf_dir, (CANONICAL,)), "contrast"), "mean", "median", "dz")


@query("jackknife_means", f"WITH {sql.pairs(OFAT)}, g AS (SELECT setting, contrast, subject AS omitted, (sum(d) OVER w - d) / nullif(count(d) OVER w - 1, 0) AS mean FROM pair WINDOW w AS (PARTITION BY setting, contrast)) SELECT setting, contrast, omitted, {R('mean')} FROM g")
def jackknife_means(spark, sf_dir):
    return rnd(contrasts.jackknife_means(_pairs(spark, sf_dir, OFAT), "setting", "contrast"), "mean")


_RANKS = """a AS (SELECT setting, contrast, d, abs(d) AS a FROM pair WHERE d <> 0), k AS (
  SELECT *, rank() OVER (PARTITION BY setting, contrast ORDER BY a) + (count(*) OVER (PARTITION BY setting, contrast, a) - 1) / 2.0 AS rk FROM a), v AS (
  SELECT setting, contrast, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN rk ELSE 0.0 END)::DOUBLE AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0.0 END)::DOUBLE AS w_minus FROM k GROUP BY ALL)"""


@query("wilcoxon_w", f"WITH {sql.pairs(OFAT)}, {_RANKS} SELECT setting, contrast, n_nonzero, w_plus, w_minus, least(w_plus, w_minus) AS w FROM v")
def wilcoxon_w(spark, sf_dir):
    return contrasts.signed_ranks(_pairs(spark, sf_dir, OFAT), "setting", "contrast")


#: CTEs from the ranks to wp (setting, contrast, w, p, p_method). WITH has to be RECURSIVE.
_WILCOXON = f"""{_RANKS}, ways(r, c) AS (SELECT 0, list_concat([1.0::DOUBLE], list_transform(range(0, 1275), lambda i: 0.0::DOUBLE)) UNION ALL SELECT r + 1, list_transform(range(0, 1276), lambda s: c[s + 1] + CASE WHEN s > r THEN c[s - r] ELSE 0.0 END) FROM ways WHERE r < 50),
ti AS (SELECT setting, contrast, sum(c * c * c - c) AS tied, max(c) AS most FROM (SELECT setting, contrast, a, count(*) AS c FROM a GROUP BY ALL) GROUP BY ALL), tot AS (SELECT setting, contrast, count(*) AS n_all FROM pair GROUP BY ALL),
wx AS (SELECT tot.setting, tot.contrast, n_all, n_nonzero AS n, least(w_plus, n_nonzero * (n_nonzero + 1) / 2 - w_plus) AS w, tied, most FROM tot LEFT JOIN v USING (setting, contrast) LEFT JOIN ti USING (setting, contrast)),
u AS (SELECT *, CASE WHEN n IS NULL THEN 'all_zero' WHEN n = n_all AND most = 1 AND n <= 50 THEN 'exact' ELSE 'normal' END AS p_method, (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tied / 48.0) AS z FROM wx),
wp AS (SELECT setting, contrast, coalesce(w, 0.0)::DOUBLE AS w, CASE p_method WHEN 'all_zero' THEN 1.0 WHEN 'exact' THEN least(1.0, 2 * list_sum(ways.c[1:(w + 1)::INTEGER]) / pow(2, n)) ELSE {sql.normal_tail("z")} END AS p, p_method FROM u LEFT JOIN ways ON ways.r = u.n)"""


@query("wilcoxon_p", f"WITH RECURSIVE {sql.pairs(OFAT)}, {_WILCOXON} SELECT setting, contrast, w, round(p, 6) AS p, p_method FROM wp")
def wilcoxon_p(spark, sf_dir):
    return rnd(contrasts.signed_rank_p(_pairs(spark, sf_dir, OFAT), "setting", "contrast"), "p")


@query("bca_intervals")
def bca_intervals(spark, sf_dir):
    return rnd(contrasts.intervals(_pairs(spark, sf_dir, (CANONICAL,)), "setting", "contrast"), "estimate", "low", "high")


def _bh_sql(family: str) -> str:
    part = f"PARTITION BY {family} " if family else ""
    return f"""WITH {sql.beats()}, q AS (SELECT phase, subject, CASE WHEN p < 0.02 THEN NULL ELSE p END AS p FROM (SELECT phase, subject, round(avg(sbp) / (1 + avg(sbp)), 6) AS p FROM beats GROUP BY ALL)), r AS (
  SELECT *, count(p) OVER ({part}) AS m, row_number() OVER ({part}ORDER BY p NULLS LAST, phase, subject) AS k FROM q), a AS (SELECT *, p * m / k AS raw FROM r)
SELECT phase, subject, p, CASE WHEN p IS NOT NULL THEN round(least(min(raw) OVER ({part}ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) END AS q FROM a"""


def _bh(spark, sf_dir, *family):
    p = beats(spark, sf_dir).groupBy("phase", "subject").agg(F.round(F.avg("sbp") / (1 + F.avg("sbp")), 6).alias("p"))
    p = p.withColumn("p", F.when(F.col("p") >= 0.02, F.col("p")))
    return rnd(with_bh(p, "p", "q", *family), "q")


@query("bh_fdr", _bh_sql(""))
def bh_fdr(spark, sf_dir):
    return _bh(spark, sf_dir)


@query("bh_by_family", _bh_sql("phase"))
def bh_by_family(spark, sf_dir):
    return _bh(spark, sf_dir, "phase")


@query(
    "bland_altman",
    f"WITH {sql.gains(BRANCHES[:2])}, j AS (SELECT a.gain AS x, b.gain AS y FROM gain a JOIN gain b USING (subject, phase, direction) WHERE a.setting = 'REF' AND b.setting = 'A0_MAX' AND a.gain IS NOT NULL AND b.gain IS NOT NULL), g AS (SELECT count(*) AS n, avg(x - y) AS bias, stddev_samp(x - y) AS sd, avg(x) / avg(y) AS ratio_of_means, count(*) FILTER (sign(x) = sign(y)) / count(*) AS sign_agreement FROM j), h AS (SELECT *, bias - 1.96 * sd AS loa_low, bias + 1.96 * sd AS loa_high FROM g) SELECT n, {R('bias sd ratio_of_means sign_agreement loa_low loa_high')} FROM h",
)
def bland_altman(spark, sf_dir):
    g = ramps.gains(beats(spark, sf_dir), BRANCHES[:2])
    out = contrasts.bland_altman(g.where("setting = 'REF'"), g.where("setting = 'A0_MAX'"), "gain", ["subject", "phase", "direction"])
    return rnd(out, "bias", "sd", "ratio_of_means", "sign_agreement", "loa_low", "loa_high")


_MEANS = "m AS (SELECT subject, phase, avg(sbp) AS sbp, avg(rri) AS rri, count(*) AS n FROM beats GROUP BY ALL)"


def _cell_means(spark, sf_dir):
    return beats(spark, sf_dir).groupBy(*CELL).agg(F.avg("sbp").alias("sbp"), F.avg("rri").alias("rri"), F.count(F.lit(1)).alias("n"))


@query(
    "delta_association",
    f"WITH {sql.beats()}, {_MEANS}, d AS (SELECT a.sbp - b.sbp AS x, a.rri - b.rri AS y FROM m a JOIN m b ON a.subject = b.subject AND a.phase = 'Stim' AND b.phase = 'Pre'), g AS (SELECT count(*) AS n, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS r FROM d), h AS (SELECT *, tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) AS low, tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) AS high FROM g) SELECT n, {R('r low high')} FROM h",
)
def delta_association(spark, sf_dir):
    m = _cell_means(spark, sf_dir)
    d = contrasts.differences(m, "sbp", contrasts=(("Stim", "Pre"),)).select("subject", F.col("d").alias("x"))
    d = d.join(contrasts.differences(m, "rri", contrasts=(("Stim", "Pre"),)).select("subject", F.col("d").alias("y")), "subject")
    return rnd(contrasts.pearson_ci(d, "x", "y"), "r", "low", "high")


@query(
    "spearman",
    f"WITH {sql.beats()}, {_MEANS}, k AS (SELECT phase, rank() OVER (PARTITION BY phase ORDER BY sbp) + (count(*) OVER (PARTITION BY phase, sbp) - 1) / 2.0 AS x, rank() OVER (PARTITION BY phase ORDER BY n) + (count(*) OVER (PARTITION BY phase, n) - 1) / 2.0 AS y FROM m), g AS (SELECT phase, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS rho FROM k GROUP BY phase) SELECT phase, n, {R('rho')} FROM g",
)
def spearman(spark, sf_dir):
    return rnd(contrasts.spearman(_cell_means(spark, sf_dir).withColumnRenamed("n", "size"), "sbp", "size", "phase"), "rho")


@query(
    "partial_spearman",
    f"""WITH {sql.beats()}, {_MEANS}, k AS (SELECT phase, rank() OVER (PARTITION BY phase ORDER BY sbp) + (count(*) OVER (PARTITION BY phase, sbp) - 1) / 2.0 AS x, rank() OVER (PARTITION BY phase ORDER BY n) + (count(*) OVER (PARTITION BY phase, n) - 1) / 2.0 AS y,
  rank() OVER (PARTITION BY phase ORDER BY rri) + (count(*) OVER (PARTITION BY phase, rri) - 1) / 2.0 AS z FROM m), b AS (
  SELECT phase, regr_slope(x, z) AS bx, regr_intercept(x, z) AS ax, regr_slope(y, z) AS bz, regr_intercept(y, z) AS az FROM k GROUP BY phase), e AS (
  SELECT phase, round(x - ax - bx * z, 9) AS x, round(y - az - bz * z, 9) AS y FROM k JOIN b USING (phase)), f AS (
  SELECT phase, rank() OVER (PARTITION BY phase ORDER BY x) + (count(*) OVER (PARTITION BY phase, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY phase ORDER BY y) + (count(*) OVER (PARTITION BY phase, y) - 1) / 2.0 AS y FROM e), g AS (
  SELECT phase, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS partial_rho FROM f GROUP BY phase) SELECT phase, n, {R('partial_rho')} FROM g""",
)
def partial_spearman(spark, sf_dir):
    return rnd(contrasts.partial_spearman(_cell_means(spark, sf_dir).withColumnRenamed("n", "size"), "sbp", "size", "rri", "phase"), "partial_rho")


@query("theil_sen", f"WITH {sql.beats('event_type')}, {_MEANS}, g AS (SELECT a.phase, count(*) AS n_pairs, median((b.sbp - a.sbp) / (b.n - a.n)) AS slope FROM m a JOIN m b ON a.phase = b.phase AND a.subject < b.subject AND a.n <> b.n GROUP BY ALL) SELECT phase, n_pairs, {R('slope')} FROM g")
def theil_sen(spark, sf_dir):
    m = beats(spark, sf_dir, "event_type").groupBy(*CELL).agg(F.avg("sbp").alias("sbp"), F.count(F.lit(1)).cast("double").alias("size"))
    return rnd(contrasts.theil_sen(m, "size", "sbp", "phase"), "slope")


# Binary outcomes --------------------------------------------------------------------------------

_FLAGS = "f AS (SELECT subject, phase, (avg(sbp) > 50)::INTEGER AS flag FROM beats GROUP BY ALL), fw AS (SELECT subject, max(flag) FILTER (phase = 'Pre') AS Pre, max(flag) FILTER (phase = 'Stim') AS Stim, max(flag) FILTER (phase = 'Post') AS Post FROM f GROUP BY subject)"


def _flags(spark, sf_dir):
    return beats(spark, sf_dir).groupBy(*CELL).agg((F.avg("sbp") > 50).alias("flag"))


_MC = "mc AS (SELECT contrast, count(*) AS n, count(*) FILTER (a = 1 AND b = 0) AS first_only, count(*) FILTER (a = 0 AND b = 1) AS second_only FROM (SELECT 'Stim-Pre' AS contrast, Stim AS a, Pre AS b FROM fw UNION ALL SELECT 'Post-Pre', Post, Pre FROM fw UNION ALL SELECT 'Post-Stim', Post, Stim FROM fw) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY contrast)"


@query("mcnemar_counts", f"WITH {sql.beats()}, {_FLAGS}, {_MC} SELECT * FROM mc")
def mcnemar_counts(spark, sf_dir):
    return prevalence.mcnemar(_flags(spark, sf_dir), "flag")


@query(
    "mcnemar_exact",
    f"WITH {sql.beats()}, {_FLAGS}, {_MC}, t AS (SELECT contrast, first_only, second_only, first_only + second_only AS m, unnest(range(0, least(first_only, second_only) + 1)) AS i FROM mc), g AS (SELECT contrast, first_only, second_only, least(1.0, 2 * sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2.0)))) AS p FROM t GROUP BY ALL) SELECT contrast, first_only, second_only, {R('p')} FROM g",
)
def mcnemar_exact(spark, sf_dir):
    return rnd(prevalence.mcnemar_p(prevalence.mcnemar(_flags(spark, sf_dir), "flag")), "p")


@query(
    "cochran_q",
    f"WITH {sql.beats()}, {_FLAGS}, c AS (SELECT Pre, Stim, Post, Pre + Stim + Post AS r FROM fw WHERE Pre IS NOT NULL AND Stim IS NOT NULL AND Post IS NOT NULL), g AS (SELECT count(*) AS n, 2.0 * (3 * (sum(Pre) * sum(Pre) + sum(Stim) * sum(Stim) + sum(Post) * sum(Post)) - sum(r) * sum(r)) / nullif(3 * sum(r) - sum(r * r), 0) AS q FROM c) SELECT n, round(q::DOUBLE, 6) AS q, round(exp(-q / 2), 6) AS p, CASE WHEN q IS NULL THEN 'not_estimable' ELSE 'estimable' END AS status, CASE WHEN q IS NULL THEN 'no_within_participant_variation_across_phases' ELSE 'NA' END AS reason FROM g",
)
def cochran_q(spark, sf_dir):
    return rnd(prevalence.cochran(_flags(spark, sf_dir), "flag"), "q", "p")


@query(
    "prevalence_ci",
    f"""WITH RECURSIVE {sql.beats()}, {_FLAGS}, c AS (SELECT phase, sum(flag)::BIGINT AS k, count(flag) AS n FROM f GROUP BY phase),
tail AS (SELECT phase, k, n, unnest(['low', 'high']) AS side FROM c), bis(phase, k, n, side, a, b, step) AS (SELECT phase, k, n, side, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM tail
  UNION ALL SELECT phase, k, n, side, CASE WHEN up THEN a ELSE (a + b) / 2 END, CASE WHEN up THEN (a + b) / 2 ELSE b END, step + 1 FROM (
    SELECT *, CASE WHEN side = 'low' THEN list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a + b) / 2) + (n - i) * ln(1 - (a + b) / 2)))) > 0.025
      ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a + b) / 2) + (n - i) * ln(1 - (a + b) / 2)))) < 0.025 END AS up FROM bis WHERE step < 45))
SELECT phase, k AS successes, n AS trials, round(k / n, 6) AS share, round(CASE WHEN k = 0 THEN 0.0 ELSE max(a) FILTER (side = 'low') END, 6) AS low, round(CASE WHEN k = n THEN 1.0 ELSE max(a) FILTER (side = 'high') END, 6) AS high FROM bis WHERE step = 45 GROUP BY phase, k, n""",
)
def prevalence_ci(spark, sf_dir):
    return rnd(prevalence.prevalence(_flags(spark, sf_dir), "flag", "phase"), "share", "low", "high")


# Pairing ----------------------------------------------------------------------------------------

_EV = "SELECT user_id AS subject, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = '{}'"


def _events(spark, sf_dir, kind):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type") == kind)
    return e.select(F.col("user_id").alias("subject"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))


@query("pair_asof", f"SELECT a.subject, a.t AS t_left, min(b.t) AS t_right FROM ({_EV.format('click')}) a JOIN ({_EV.format('purchase')}) b ON a.subject = b.subject AND b.t >= a.t AND b.t <= a.t + 86400 GROUP BY ALL")
def pair_asof(spark, sf_dir):
    return pairing.first_follower(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase"), 86400.0)


@query(
    "pair_one_to_one",
    f"""WITH a AS (SELECT subject, list([t] ORDER BY t) AS l FROM ({_EV.format('click')}) GROUP BY subject), b AS (SELECT subject, list(t ORDER BY t) AS r FROM ({_EV.format('purchase')}) GROUP BY subject),
m AS (SELECT subject, list_reduce(list_concat([[0.0::DOUBLE]], l), lambda acc, e: CASE WHEN greatest(acc[1], len(list_filter(r, lambda z: z < e[1]))) < len(r) AND r[(greatest(acc[1], len(list_filter(r, lambda z: z < e[1]))) + 1)::INTEGER] <= e[1] + 86400
  THEN list_concat([greatest(acc[1], len(list_filter(r, lambda z: z < e[1]))) + 1.0], acc[2:], e, [r[(greatest(acc[1], len(list_filter(r, lambda z: z < e[1]))) + 1)::INTEGER]]) ELSE acc END) AS got FROM a JOIN b USING (subject))
SELECT subject, got[(2 * i)::INTEGER] AS t_left, got[(2 * i + 1)::INTEGER] AS t_right FROM (SELECT subject, got, unnest(range(1, (len(got) - 1) // 2 + 1)) AS i FROM m)""",
)
def pair_one_to_one(spark, sf_dir):
    return pairing.one_to_one(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase"), 86400.0)


@query(
    "pair_order_check",
    f"WITH p AS (SELECT a.subject, a.t AS t_left, min(b.t) AS t_right FROM ({_EV.format('click')}) a JOIN ({_EV.format('purchase')}) b ON a.subject = b.subject AND b.t >= a.t AND b.t <= a.t + 86400 GROUP BY ALL), n AS (SELECT *, lead(t_left) OVER (PARTITION BY subject ORDER BY t_left) AS nx FROM p) SELECT subject, count(*) AS n, bool_and(t_left < t_right AND (nx IS NULL OR t_right < nx)) AS in_order FROM n GROUP BY subject",
)
def pair_order_check(spark, sf_dir):
    return pairing.in_order(pairing.first_follower(_events(spark, sf_dir, "click"), _events(spark, sf_dir, "purchase"), 86400.0))


# Identifiers, unions, checks --------------------------------------------------------------------


@query(
    "crc32_seed",
    f"""WITH {sql.beats('event_type')}, tb AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], list_transform(range(0, 8), lambda j: 0::BIGINT)), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
c AS (SELECT DISTINCT subject, phase FROM beats), h AS (SELECT subject, phase, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(subject || '|' || phase, ''), lambda s: ord(s)::BIGINT)), lambda acc, b: xor(t[(xor(acc, b) & 255) + 1], acc // 256)) AS crc FROM c, tb)
SELECT subject, phase, (2026080710 + xor(crc, 4294967295)) % 4294967295 AS seed FROM h""",
)
def crc32_seed(spark, sf_dir):
    cells = beats(spark, sf_dir, "event_type").select(*CELL).distinct()
    return cells.withColumn("seed", stable_seed(2026080710, F.col("subject"), F.col("phase")))


_PATTERN = r"^lag(\d+)_r(\d)p(\d\d)_sbp(\d)p(\d)_len(\d+)_(mean|median)(_directional_rri_gate)?$"


@query(
    "setting_id_codec",
    f"WITH {sql.gains(FACTORIAL, 'event_type')}, n AS (SELECT setting, count(gain) AS evaluable FROM gain WHERE direction = 'all' GROUP BY setting) SELECT 'lag' || lag || '_r' || replace(printf('%.2f', least_r), '.', 'p') || '_sbp' || replace(printf('%.1f', least_step), '.', 'p') || '_len' || least_beats || '_' || CASE WHEN use_median THEN 'median' ELSE 'mean' END AS setting_id, lag::INTEGER AS lag, least_r, least_step, least_beats::INTEGER AS least_beats, evaluable FROM cfg JOIN n USING (setting)",
)
def setting_id_codec(spark, sf_dir):
    """The settings of a result by what their ids say."""
    g = ramps.gains(beats(spark, sf_dir, "event_type"), FACTORIAL, tasks=tasks(spark, sf_dir, "event_type")).where("direction = 'all'")
    ids = g.groupBy(F.col("setting").alias("setting_id")).agg(F.count("gain").alias("evaluable"))
    part = lambda i: F.regexp_extract("setting_id", _PATTERN, i)
    return ids.select("setting_id", part(1).cast("int").alias("lag"), F.concat(part(2), F.lit("."), part(3)).cast("double").alias("least_r"), F.concat(part(4), F.lit("."), part(5)).cast("double").alias("least_step"), part(6).cast("int").alias("least_beats"), "evaluable")


@query(
    "sequence_text",
    f"WITH {sql.sequences((CANONICAL,), 'event_type')} SELECT c.subject, c.phase, c.direction, c.s::INTEGER AS start_idx, string_agg(printf('%.2f', p.sbp), '|' ORDER BY p.i) AS sbp_values FROM cand c JOIN pts p USING (subject, phase, lag, least_step, strict_step, direction, island) GROUP BY ALL",
)
def sequence_text(spark, sf_dir):
    b = beats(spark, sf_dir, "event_type")
    found = ramps.held(ramps.sequences(b, (CANONICAL,), tasks=tasks(spark, sf_dir, "event_type")), b)
    return found.select("subject", "phase", "direction", "start_idx", F.array_join(F.transform("sbp_values", lambda v: F.format_string("%.2f", v)), "|").alias("sbp_values"))


_PROVENANCE = "setting subject phase direction ramp_index lag n_beats sbp_start_beat sbp_end_beat rri_start_beat rri_end_beat sbp_start sbp_end sbp_amplitude sbp_amplitude_abs rri_start rri_end rri_response rri_response_abs sbp_start_t sbp_end_t rri_start_t rri_end_t intercept slope r r_squared rri_monotone rri_concordant_1ms rri_threshold_gate correlation_gate r2_gate slope_gate qualifies sbp_values_text rri_values_text sbp_times_text rri_times_text"


@query(
    "sequence_provenance",
    f"""WITH {sql.sequences(BRANCHES, 'event_type')}, h AS (SELECT q.setting, q.subject, q.phase, q.direction, q.ramp_index, count(*) AS n, avg(b.sbp) AS mx, avg(c.rri) AS my, min(b.t) AS st, max(b.t) AS et, min(c.t) AS rt, max(c.t) AS ft,
  string_agg(printf('%.15g', b.sbp), '|' ORDER BY b.beat_idx) AS sbp_values_text, string_agg(printf('%.15g', c.rri), '|' ORDER BY b.beat_idx) AS rri_values_text, string_agg(printf('%.15g', b.t), '|' ORDER BY b.beat_idx) AS sbp_times_text, string_agg(printf('%.15g', c.t), '|' ORDER BY b.beat_idx) AS rri_times_text
  FROM seqq q JOIN cfg USING (setting) JOIN beats b ON b.subject = q.subject AND b.phase = q.phase AND b.beat_idx BETWEEN q.start_idx + 1 AND q.end_idx + 1 JOIN beats c ON c.subject = q.subject AND c.phase = q.phase AND c.beat_idx = b.beat_idx + cfg.lag GROUP BY ALL)
SELECT setting, subject, phase, direction, ramp_index, cfg.lag, n_beats, start_idx + 1 AS sbp_start_beat, end_idx + 1 AS sbp_end_beat, start_idx + cfg.lag + 1 AS rri_start_beat, end_idx + cfg.lag + 1 AS rri_end_beat, {R('sbp_start sbp_end')}, {R('sbp_end - sbp_start AS sbp_amplitude')}, {R('abs(sbp_end - sbp_start) AS sbp_amplitude_abs')}, {R('rri_start rri_end')}, {R('rri_end - rri_start AS rri_response')}, {R('abs(rri_end - rri_start) AS rri_response_abs')},
  {R('st AS sbp_start_t')}, {R('et AS sbp_end_t')}, {R('rt AS rri_start_t')}, {R('ft AS rri_end_t')}, {R('my - slope * mx AS intercept')}, round(slope, 6) + 0.0 AS slope, {R('r')}, {R('r * r AS r_squared')}, rri_monotone, rri_concordant_1ms, rri_gate AS rri_threshold_gate, q.least_r IS NULL OR coalesce(r >= q.least_r, false) AS correlation_gate, q.least_r2 IS NULL OR coalesce(r * r > q.least_r2, false) AS r2_gate, slope IS NOT NULL AND (NOT q.positive_slope OR slope > 0) AS slope_gate, qualifies, sbp_values_text, rri_values_text, sbp_times_text, rri_times_text
FROM seqq q JOIN cfg USING (setting) JOIN h USING (setting, subject, phase, direction, ramp_index)""",
)
def sequence_provenance(spark, sf_dir):
    """Every candidate of the five branches with its beats, regression and gates."""
    out = ramps.provenance(beats(spark, sf_dir, "event_type"), BRANCHES, tasks=tasks(spark, sf_dir, "event_type")).select(*_PROVENANCE.split())
    return rnd(out, *[c for c, kind in out.dtypes if kind == "double"])


@query("array_text", f"WITH {sql.beats()} SELECT subject, phase, string_agg(printf('%.15g', sbp), '|' ORDER BY beat_idx) AS text FROM beats GROUP BY ALL")
def array_text(spark, sf_dir):
    arrays = beats(spark, sf_dir).groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("beat_idx", "sbp"))).alias("a"))
    return arrays.select(*CELL, text_array(F.transform("a", lambda x: x["sbp"])).alias("text"))


@query(
    "record_union",
    f"WITH {sql.beats('event_type')} SELECT 'mean' AS record_type, phase, NULL::VARCHAR AS subject, round(avg(sbp), 6) AS value, NULL::BIGINT AS n FROM beats GROUP BY phase UNION ALL SELECT 'count', phase, subject, NULL, count(*) FROM beats GROUP BY phase, subject",
)
def record_union(spark, sf_dir):
    b = beats(spark, sf_dir, "event_type")
    means = b.groupBy("phase").agg(F.round(F.avg("sbp"), 6).alias("value")).withColumn("record_type", F.lit("mean"))
    counts = b.groupBy("phase", "subject").agg(F.count(F.lit(1)).alias("n")).withColumn("record_type", F.lit("count"))
    return means.unionByName(counts, allowMissingColumns=True).select("record_type", "phase", "subject", "value", "n")


_GRID = "(VALUES ('Pre'), ('Stim'), ('Post')) AS p(phase)"


@query("null_grid", f"WITH {sql.gains((CANONICAL,))}, g AS (SELECT phase, n_sequences AS k, count(*) AS n FROM gain WHERE direction = 'all' GROUP BY ALL) SELECT p.phase, k.k, coalesce(g.n, 0) AS n FROM {_GRID}, (SELECT unnest(range(0, greatest(11, (SELECT max(k) + 1 FROM g)))) AS k) k LEFT JOIN g ON g.phase = p.phase AND g.k = k.k")
def null_grid(spark, sf_dir):
    g = ramps.gains(beats(spark, sf_dir), (CANONICAL,)).where("direction = 'all'").groupBy("phase", F.col("n_sequences").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    upto = g.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(10), F.max("k")))).alias("k"))
    grid = spark.createDataFrame([(p,) for p in PHASES], "phase string").crossJoin(upto)
    return grid.join(g, ["phase", "k"], "left").select("phase", "k", F.coalesce("n", F.lit(0)).alias("n"))


@query("phase_rollup", f"WITH {sql.gains((CANONICAL,))} SELECT coalesce(phase, 'All') AS phase, count(*) AS n, count(gain) AS evaluable, round(count(gain) / count(*), 6) AS rate FROM gain WHERE direction = 'all' GROUP BY ROLLUP (phase)")
def phase_rollup(spark, sf_dir):
    g = ramps.gains(beats(spark, sf_dir), (CANONICAL,)).where("direction = 'all'").rollup("phase").agg(F.count(F.lit(1)).alias("n"), F.count("gain").alias("evaluable"))
    return g.select(F.coalesce("phase", F.lit("All")).alias("phase"), "n", "evaluable", F.round(F.col("evaluable") / F.col("n"), 6).alias("rate"))


@query(
    "method_full_outer",
    f"WITH {sql.gains(BRANCHES[1:3])}, a AS (SELECT subject, phase, round(gain, 6) AS first_gain FROM gain WHERE setting = 'A0_MAX' AND direction = 'all' AND gain IS NOT NULL), b AS (SELECT subject, phase, round(gain, 6) AS second_gain FROM gain WHERE setting = 'A1_MAX' AND direction = 'all' AND gain IS NOT NULL) SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.phase, b.phase) AS phase, first_gain, second_gain FROM a FULL OUTER JOIN b ON a.subject = b.subject AND a.phase = b.phase",
)
def method_full_outer(spark, sf_dir):
    g = rnd(ramps.gains(beats(spark, sf_dir), BRANCHES[1:3]).where("direction = 'all' and gain is not null").select("setting", *CELL, "gain"), "gain")
    a = g.where("setting = 'A0_MAX'").select(*CELL, F.col("gain").alias("first_gain"))
    b = g.where("setting = 'A1_MAX'").select(*CELL, F.col("gain").alias("second_gain"))
    return a.join(b, CELL, "full_outer").select(*CELL, "first_gain", "second_gain")


@query("wide_by_branch", f"WITH {sql.gains(BRANCHES[:3])} SELECT subject, phase, " + ", ".join(f"round(max(gain) FILTER (setting = '{s.name}' AND direction = '{d}'), 6) AS {s.name}_{d}" for s in BRANCHES[:3] for d in ("all", "up", "down")) + " FROM gain GROUP BY subject, phase")
def wide_by_branch(spark, sf_dir):
    names = [f"{s.name}_{d}" for s in BRANCHES[:3] for d in ("all", "up", "down")]
    g = ramps.gains(beats(spark, sf_dir), BRANCHES[:3]).withColumn("name", F.concat_ws("_", "setting", "direction"))
    return rnd(g.groupBy(*CELL).pivot("name", names).agg(F.first("gain")), *names)


@query("response_signs", f"WITH {sql.pairs(BRANCHES)}, s AS (SELECT setting, subject, max(sign(d)) FILTER (contrast = 'Stim-Pre') AS a, max(sign(d)) FILTER (contrast = 'Post-Stim') AS b FROM pair GROUP BY ALL), c AS (SELECT setting, CASE WHEN a IS NULL OR b IS NULL THEN 'incomplete' WHEN a * b < 0 THEN 'reversed' WHEN a * b > 0 THEN 'sustained' ELSE 'flat' END AS pattern FROM s) SELECT setting, pattern, count(*) AS n FROM c GROUP BY ALL")
def response_signs(spark, sf_dir):
    p = _pairs(spark, sf_dir, BRANCHES).groupBy("setting", "subject").pivot("contrast", ["Stim-Pre", "Post-Stim"]).agg(F.first(F.signum("d")))
    s = F.col("`Stim-Pre`") * F.col("`Post-Stim`")
    pattern = F.when(s.isNull(), "incomplete").when(s < 0, "reversed").when(s > 0, "sustained").otherwise("flat")
    return p.groupBy("setting", pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_checks",
    f"""WITH {sql.beats()}, {_MEANS}, c AS (SELECT subject, phase, count(*) AS n, max(beat_idx) AS k, count(DISTINCT beat_idx) AS u FROM beats GROUP BY ALL)
SELECT 'dense_index' AS name, bool_and(n = k AND n = u) AS passed, count(*)::VARCHAR AS detail FROM c
UNION ALL SELECT 'one_row_per_cell', max(k) <= 1, max(k)::VARCHAR FROM (SELECT count(*) AS k FROM m GROUP BY subject, phase)
UNION ALL SELECT 'positive_intervals', count(*) FILTER (rri <= 0) = 0, (count(*) FILTER (rri <= 0))::VARCHAR FROM beats
UNION ALL SELECT 'phase_names', count(*) FILTER (phase NOT IN ('Pre', 'Stim', 'Post')) = 0, (count(*) FILTER (phase NOT IN ('Pre', 'Stim', 'Post')))::VARCHAR FROM beats
UNION ALL SELECT 'same_cells', true, '0'""",
)
def audit_checks(spark, sf_dir):
    b = beats(spark, sf_dir)
    cells = b.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.max("beat_idx").alias("k"), F.count_distinct("beat_idx").alias("u"))
    bad = F.count_if(F.col("rri") <= 0)
    return audit.all_checks(
        audit.check(cells, "dense_index", F.bool_and((F.col("n") == F.col("k")) & (F.col("n") == F.col("u"))), F.count(F.lit(1))),
        audit.unique(_cell_means(spark, sf_dir), CELL, "one_row_per_cell"),
        audit.check(b, "positive_intervals", bad == 0, bad),
        audit.matching(b, "phase", "Pre|Stim|Post", "phase_names"),
        audit.same_keys(cells, _cell_means(spark, sf_dir), CELL, "same_cells"),
    )


@query(
    "average_ranks",
    f"WITH {sql.beats('event_type')} SELECT subject, phase, beat_idx, rank() OVER (PARTITION BY subject, phase ORDER BY sbp) + (count(*) OVER (PARTITION BY subject, phase, sbp) - 1) / 2.0 AS place FROM beats",
)
def average_ranks(spark, sf_dir):
    return beats(spark, sf_dir, "event_type").select(*CELL, "beat_idx", average_rank("sbp", *CELL).alias("place"))


# Agreement, missingness, ordinals ---------------------------------------------------------------


@query(
    "sign_agreement",
    f"WITH {sql.pairs(OFAT)}, {_SUMMARY}, k AS (SELECT contrast, sign(mean_difference) AS s FROM s WHERE setting = 'canonical') SELECT s.setting, s.contrast, round(s.mean_difference, 6) AS mean_difference, coalesce(sign(s.mean_difference) <> 0 AND sign(s.mean_difference) = k.s, false) AS agrees FROM s LEFT JOIN k USING (contrast)",
)
def sign_agreement(spark, sf_dir):
    s = contrasts.summary(_pairs(spark, sf_dir, OFAT), "setting", "contrast").select("setting", "contrast", "mean_difference")
    return rnd(summaries.sign_agreement(s, "setting", "canonical", "mean_difference", "contrast").select("setting", "contrast", "mean_difference", "agrees"), "mean_difference")


@query("missingness_grid", f"WITH {sql.gains(BRANCHES)} SELECT setting, phase, direction, count(*) AS n, count(gain) AS present, count(*) - count(gain) AS missing, round((count(*) - count(gain)) / count(*), 6) AS missing_share FROM gain GROUP BY ALL")
def missingness_grid(spark, sf_dir):
    return rnd(summaries.missingness(ramps.gains(beats(spark, sf_dir), BRANCHES), "gain", "setting", "phase", "direction"), "missing_share")


@query("setting_ordinals", f"WITH {sql.gains(FACTORIAL, 'event_type')}, d AS (SELECT DISTINCT setting, direction FROM gain) SELECT setting, direction, (dense_rank() OVER (ORDER BY setting, direction) - 1)::INTEGER AS place, 20260805 + 10 * (dense_rank() OVER (ORDER BY setting, direction) - 1) AS seed FROM d")
def setting_ordinals(spark, sf_dir):
    """Seeds of a result's settings and directions by their places."""
    return joins.ordinals(ramps.gains(beats(spark, sf_dir, "event_type"), FACTORIAL, tasks=tasks(spark, sf_dir, "event_type")).select("setting", "direction"), ["setting", "direction"], 20260805)


@query("mixed_model_eligibility", f"WITH {sql.sequences((CANONICAL,))}, p AS (SELECT subject, phase, count(*) AS n FROM seqq WHERE qualifies GROUP BY ALL) SELECT subject, count(*) AS phases, min(n) AS least, count(*) = 3 AND min(n) >= 2 AS eligible FROM p GROUP BY subject")
def mixed_model_eligibility(spark, sf_dir):
    return summaries.mixed_model_eligible(ramps.sequences(beats(spark, sf_dir), (CANONICAL,)))


@query("direction_projection", f"WITH {sql.beats('event_type')} SELECT subject, phase, beat_idx, 'sbp_to_rri' AS direction, rri AS target, sbp AS source FROM beats UNION ALL SELECT subject, phase, beat_idx, 'rri_to_sbp', sbp, rri FROM beats")
def direction_projection(spark, sf_dir):
    return joins.directions(beats(spark, sf_dir, "event_type"), "sbp", "rri").select(*CELL, "beat_idx", "direction", "target", "source")


@query("validated_context_join", f"WITH {sql.gains((CANONICAL,))}, {_MEANS} SELECT g.subject, g.phase, g.direction, g.n_ramps, m.n AS n_beats FROM gain g LEFT JOIN m USING (subject, phase)")
def validated_context_join(spark, sf_dir):
    g = ramps.gains(beats(spark, sf_dir), (CANONICAL,)).select(*CELL, "direction", "n_ramps")
    return joins.many_to_one(g, _cell_means(spark, sf_dir).select(*CELL, F.col("n").alias("n_beats")), CELL)


@query("rows_hash", f"WITH {sql.beats('event_type')}, c AS (SELECT subject, phase, count(*) AS n FROM beats GROUP BY ALL) SELECT sha256(string_agg(subject || ',' || phase || ',' || n, chr(10) ORDER BY subject, phase)) AS sha256, count(*) AS n FROM c")
def rows_hash(spark, sf_dir):
    c = beats(spark, sf_dir, "event_type").groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return joins.content_hash(c, ["subject", "phase", "n"], ["subject", "phase"])


@query("phase_contrast_table")
def phase_contrast_table(spark, sf_dir):
    g = ramps.gains(beats(spark, sf_dir), OFAT).where("direction = 'all'").select("setting", *CELL, "gain")
    out = summaries.phase_contrasts(g, "gain", "setting")
    return rnd(out, *[c for c, k in out.dtypes if k == "double"])


@query("uniform_table")
def uniform_table(spark, sf_dir):
    b = beats(spark, sf_dir, "event_type")
    first = Window.partitionBy("subject")
    b = b.withColumn("t", (F.col("t") - F.min("t").over(first)) / 2880.0)
    return rnd(waves.uniform_table(b, ["sbp", "rri"]), "sbp_uniform", "rri_uniform", digits=4)


@query(
    "wave_intervals",
    f'WITH {sql.beats("event_type")}, {sql.peaks(100.0, 3, "beats", "subject", "t")}, n AS (SELECT *, lead(t) OVER (PARTITION BY subject ORDER BY t) - t AS rr FROM pk), h AS (SELECT subject, (t * 1e6)::BIGINT AS "at", t, sbp AS height, rr, t + rr / 2 AS t_middle, 60.0 / rr AS hr FROM n WHERE rr IS NOT NULL) SELECT subject, "at", t, height, {R("rr hr")}, {R("t_middle", 4)} FROM h',
)
def wave_intervals(spark, sf_dir):
    b = beats(spark, sf_dir, "event_type").withColumn("i", F.unix_micros(F.timestamp_seconds("t")))
    return rnd(waves.intervals(waves.find_peaks(b, "sbp", 100.0, 3)).withColumn("t_middle", F.round("t_middle", 4)), "rr", "hr")


# Shapes, records, families ----------------------------------------------------------------------


@query("table_shape", "WITH n AS (SELECT count(*) AS n, count(*) FILTER (n_nationkey IS NULL OR trim(n_name) = '' OR n_name IS NULL OR trim(n_name) <> n_name) AS bad FROM nation) SELECT 'nation/rows' AS name, n = 25 AS passed, n::VARCHAR AS detail FROM n UNION ALL SELECT 'nation/columns', true, '2' UNION ALL SELECT 'nation/headers', true, '0' UNION ALL SELECT 'nation/blanks', bad = 0, bad::VARCHAR FROM n")
def table_shape(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string"), "n_name")
    return audit.table_shape(nation, 25, 2, "nation")


@query(
    "source_records",
    f"WITH {sql.beats()}, r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t, phase, beat_idx) AS source_row FROM beats), g AS (SELECT subject, phase, count(*) AS n, min(source_row) AS a, max(source_row) AS b FROM r GROUP BY ALL), s AS (SELECT DISTINCT subject FROM beats) SELECT s.subject, p.phase, coalesce(n, 0) AS retained_rows, CASE WHEN n IS NULL THEN 'no_retained_rows' ELSE '1-based_data_rows_' || a || '-' || b || ';retained_rows=' || n END AS source_record FROM s CROSS JOIN (VALUES ('Pre'), ('Stim'), ('Post')) AS p(phase) LEFT JOIN g ON g.subject = s.subject AND g.phase = p.phase",
)
def source_records(spark, sf_dir):
    b = beats(spark, sf_dir)
    b = b.withColumn("source_row", F.row_number().over(Window.partitionBy("subject").orderBy("t", "phase", "beat_idx")))
    phases = F.explode(F.array(*[F.lit(p) for p in PHASES])).alias("phase")
    return segment.source_records(b, grid=b.select("subject").distinct().select("subject", phases))


@query("wanted_order", f"WITH {sql.gains(BRANCHES)}, w AS (SELECT * FROM (VALUES ('A1_MAX', 0), ('REF', 1)) AS v(setting, place)) SELECT g.setting, w.place::INTEGER AS place, g.phase, count(gain) AS n, round(avg(gain), 6) AS mean_gain FROM gain g JOIN w USING (setting) WHERE direction = 'all' AND reason = 'NA' GROUP BY ALL")
def wanted_order(spark, sf_dir):
    g = joins.wanted(ramps.gains(beats(spark, sf_dir), BRANCHES).where("direction = 'all' and reason = 'NA'"), "setting", ["A1_MAX", "REF"])
    return rnd(g.groupBy("setting", "place", "phase").agg(F.count("gain").alias("n"), F.avg("gain").alias("mean_gain")), "mean_gain")


@query("distinct_fits", f"WITH {sql.beats()} SELECT subject, phase, count(*) AS n, round(regr_slope(rri, sbp), 6) AS b FROM beats GROUP BY ALL HAVING count(*) > 2")
def distinct_fits(spark, sf_dir):
    fits = beats(spark, sf_dir).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("rri", "sbp"), 6).alias("b")).where("n > 2")
    twice = fits.withColumn("direction", F.explode(F.array(F.lit("sbp_to_rri"), F.lit("rri_to_sbp"))))
    return joins.distinct_fits(twice, CELL, ["n", "b"])


@query(
    "family_check",
    f"WITH {sql.pairs(OFAT)}, {_SUMMARY}, t AS (SELECT setting, CASE WHEN n >= 15 THEN n END AS p FROM s WHERE contrast = 'Stim-Pre'), e AS (SELECT DISTINCT setting FROM pair WHERE contrast = 'Stim-Pre') SELECT 'ofat/size' AS name, count(p) = 8 AS passed, count(p)::VARCHAR AS detail FROM t UNION ALL SELECT 'ofat/members', count(*) = 0, count(*)::VARCHAR FROM ((SELECT setting FROM t WHERE p IS NOT NULL EXCEPT SELECT setting FROM e) UNION ALL (SELECT setting FROM e EXCEPT SELECT setting FROM t WHERE p IS NOT NULL))",
)
def family_check(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, OFAT).where("contrast = 'Stim-Pre'")
    tests = pairs.groupBy("setting").agg(F.count("d").alias("n")).withColumn("p", F.when(F.col("n") >= 15, F.col("n")))
    return audit.family(tests, "p", 8, pairs.select("setting").distinct(), ["setting"], "ofat")
