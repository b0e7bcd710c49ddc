"""DuckDB SQL building blocks of the registered queries: beats, ramps, gains and their contrasts."""

from __future__ import annotations

from ..schema import CONTRASTS, Setting


def beats(key: str = "user_id", valid: bool = True) -> str:
    keep = "WHERE rri IS NOT NULL AND rri > 0 AND sbp IS NOT NULL AND isfinite(sbp)" if valid else ""
    return f"""ev AS (
  SELECT CAST({key} AS VARCHAR) AS subject, event_id, ts, epoch_us(ts) AS us, value AS sbp,
         (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id)) / 3.6e9 AS rri
  FROM events
), beats AS (
  SELECT subject, phase, (row_number() OVER (PARTITION BY subject, phase ORDER BY us, event_id))::INTEGER AS beat_idx, us / 1e6 AS t, rri, sbp
  FROM (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'Pre' WHEN ts < TIMESTAMP '2024-01-21' THEN 'Stim' ELSE 'Post' END AS phase FROM ev)
  {keep}
)"""


def _lit(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"{x}"


def settings(chosen: tuple[Setting, ...]) -> str:
    rows = ", ".join(
        "(" + ", ".join(map(_lit, (s.name, i, s.lag, float(s.least_step), s.strict_step, s.least_beats, s.overlap, s.least_r, s.least_r2, s.positive_slope, s.rri_direction, s.least_rri_step, s.median))) + ")"
        for i, s in enumerate(chosen)
    )
    return f"""cfg AS (
  SELECT setting, ordinal, lag, least_step::DOUBLE AS least_step, strict_step, least_beats, overlap, least_r::DOUBLE AS least_r, least_r2::DOUBLE AS least_r2,
         positive_slope, rri_direction, least_rri_step::DOUBLE AS least_rri_step, use_median
  FROM (VALUES {rows}) AS v(setting, ordinal, lag, least_step, strict_step, least_beats, overlap, least_r, least_r2, positive_slope, rri_direction, least_rri_step, use_median)
)"""


def sequences(chosen: tuple[Setting, ...], key: str = "user_id") -> str:
    """CTEs up to ``seq``: every candidate of every setting."""
    lags = sorted({s.lag for s in chosen})
    aligned = " UNION ALL ".join(
        f"SELECT subject, phase, beat_idx, sbp, {k} AS lag, lead(rri, {k}) OVER (PARTITION BY subject, phase ORDER BY beat_idx) AS rri, lead(beat_idx, {k}) OVER (PARTITION BY subject, phase ORDER BY beat_idx) AS nx FROM beats"
        for k in lags
    )
    return f"""{beats(key)}, {settings(chosen)}, rules AS (SELECT DISTINCT lag, least_step, strict_step FROM cfg), al AS ({aligned}), st AS (
  SELECT al.subject, al.phase, r.lag, r.least_step, r.strict_step, al.sbp, al.rri,
         row_number() OVER w - 1 AS i, lag(al.sbp) OVER w AS ps, lag(al.rri) OVER w AS pr
  FROM al JOIN rules r ON r.lag = al.lag WHERE al.nx IS NOT NULL
  WINDOW w AS (PARTITION BY al.subject, al.phase, r.lag, r.least_step, r.strict_step ORDER BY al.beat_idx)
), dr AS (
  SELECT *, CASE WHEN ps IS NULL OR sbp = ps THEN NULL
                 WHEN (strict_step AND abs(sbp - ps) > least_step) OR (NOT strict_step AND abs(sbp - ps) >= least_step)
                 THEN CASE WHEN sbp > ps THEN 'up' ELSE 'down' END END AS direction FROM st
), fi AS (
  SELECT *, direction IS NOT NULL AND direction IS DISTINCT FROM lag(direction) OVER (PARTITION BY subject, phase, lag, least_step, strict_step ORDER BY i) AS first FROM dr
), isl AS (
  SELECT *, sum(first::INTEGER) OVER (PARTITION BY subject, phase, lag, least_step, strict_step ORDER BY i) AS island FROM fi
), pts AS (
  SELECT subject, phase, lag, least_step, strict_step, direction, island, i, sbp, rri, CASE WHEN first THEN NULL ELSE rri - pr END AS dr, rri - pr AS step FROM isl WHERE direction IS NOT NULL
  UNION ALL
  SELECT subject, phase, lag, least_step, strict_step, direction, island, i - 1, ps, pr, NULL, NULL FROM isl WHERE first AND direction IS NOT NULL
), ramp AS (
  SELECT subject, phase, lag, least_step, strict_step, direction, island, min(i) AS s, max(i) AS e FROM pts GROUP BY ALL
), cand AS (
  SELECT c.*, r.subject, r.phase, r.direction, r.island, r.s AS maximal_start, r.s, r.e FROM ramp r JOIN cfg c USING (lag, least_step, strict_step) WHERE NOT c.overlap AND r.e - r.s + 1 >= c.least_beats
  UNION ALL
  SELECT x.* FROM (
    SELECT c.*, r.subject, r.phase, r.direction, r.island, r.s AS maximal_start, a.i AS s, b.i AS e
    FROM ramp r JOIN cfg c USING (lag, least_step, strict_step)
    JOIN (SELECT DISTINCT i FROM pts) a ON a.i BETWEEN r.s AND r.e
    JOIN (SELECT DISTINCT i FROM pts) b ON b.i BETWEEN a.i + c.least_beats - 1 AND r.e
    WHERE c.overlap) x
), seq AS (
  SELECT c.setting, c.subject, c.phase, c.direction, c.maximal_start, c.s::INTEGER AS start_idx, c.e::INTEGER AS end_idx, count(*)::INTEGER AS n_beats,
         first(p.sbp ORDER BY p.i) AS sbp_start, last(p.sbp ORDER BY p.i) AS sbp_end, first(p.rri ORDER BY p.i) AS rri_start, last(p.rri ORDER BY p.i) AS rri_end,
         covar_pop(p.rri, p.sbp) / nullif(stddev_pop(p.rri) * stddev_pop(p.sbp), 0) AS r, covar_pop(p.rri, p.sbp) / nullif(var_pop(p.sbp), 0) AS slope,
         bool_and(CASE WHEN p.i = c.s THEN NULL ELSE CASE WHEN c.direction = 'up' THEN p.step ELSE -p.step END > 0 END) AS rri_monotone,
         bool_and(CASE WHEN p.i = c.s THEN NULL ELSE CASE WHEN c.direction = 'up' THEN p.step ELSE -p.step END >= 1.0 END) AS rri_concordant_1ms,
         bool_and(CASE WHEN p.i = c.s THEN NULL ELSE CASE WHEN c.direction = 'up' THEN p.step ELSE -p.step END > coalesce(c.least_rri_step, 0) END) AS rri_gate,
         any_value(c.least_r) AS least_r, any_value(c.least_r2) AS least_r2, any_value(c.positive_slope) AS positive_slope, any_value(c.rri_direction) AS rri_direction, any_value(c.use_median) AS use_median
  FROM cand c JOIN pts p USING (subject, phase, lag, least_step, strict_step, direction, island)
  WHERE p.i BETWEEN c.s AND c.e GROUP BY c.setting, c.subject, c.phase, c.direction, c.maximal_start, c.s, c.e
), seqq AS (
  SELECT *, coalesce(slope IS NOT NULL AND (NOT positive_slope OR slope > 0) AND (least_r IS NULL OR r >= least_r)
         AND (least_r2 IS NULL OR r * r > least_r2) AND (NOT rri_direction OR rri_gate) AND (r IS NOT NULL OR least_r IS NULL), false) AS qualifies,
         (row_number() OVER (PARTITION BY setting, subject, phase, direction ORDER BY start_idx, end_idx))::INTEGER AS ramp_index
  FROM seq
)"""


def gains(chosen: tuple[Setting, ...], key: str = "user_id") -> str:
    """CTEs up to ``gain``: one row per setting, cell and direction up, down, all."""
    return f"""{sequences(chosen, key)}, both_ways AS (
  SELECT *, direction AS found, unnest([direction, 'all']) AS dir FROM seqq
), grid AS (
  SELECT c.setting, c.use_median, c.rri_direction, b.subject, b.phase, d.direction
  FROM cfg c, (SELECT DISTINCT subject, phase FROM beats) b, (VALUES ('up'), ('down'), ('all')) AS d(direction)
), made AS (
  SELECT setting, subject, phase, dir AS direction, count(*) AS n_ramps, count(*) FILTER (qualifies) AS n_sequences,
         count(DISTINCT found || '/' || maximal_start) AS n_maximal, count(*) FILTER (rri_gate) AS n_gate,
         avg(slope) FILTER (qualifies) AS mean_slope, median(slope) FILTER (qualifies) AS median_slope, avg(n_beats) FILTER (qualifies) AS mean_beats,
         avg(r) FILTER (qualifies) AS mean_r, avg(r * r) FILTER (qualifies) AS mean_r2,
         avg(abs(sbp_end - sbp_start)) FILTER (qualifies) AS mean_sbp_amplitude, avg(abs(rri_end - rri_start)) FILTER (qualifies) AS mean_rri_response
  FROM both_ways GROUP BY ALL
), gain AS (
  SELECT g.setting, g.subject, g.phase, g.direction, coalesce(n_ramps, 0) AS n_ramps, coalesce(n_maximal, 0) AS n_maximal, coalesce(n_sequences, 0) AS n_sequences,
         n_sequences / nullif(n_ramps, 0) AS bei, CASE WHEN use_median THEN median_slope ELSE mean_slope END AS gain,
         mean_beats, mean_r, mean_r2, mean_sbp_amplitude, mean_rri_response,
         CASE WHEN coalesce(n_ramps, 0) = 0 THEN 'NO_CANDIDATE_SBP_RAMP' WHEN n_sequences > 0 THEN 'NA'
              WHEN NOT rri_direction THEN 'NO_CANDIDATE_PASSED_CORRELATION' WHEN coalesce(n_gate, 0) = 0 THEN 'NO_RRI_THRESHOLD_CONCORDANT_CANDIDATE'
              ELSE 'NO_CANDIDATE_PASSED_R2_AND_SLOPE' END AS reason
  FROM grid g LEFT JOIN made m USING (setting, subject, phase, direction)
)"""


def pairs(chosen: tuple[Setting, ...], key: str = "user_id", direction: str = "all", value: str = "gain", more: str = "") -> str:
    """CTEs up to ``pair``: complete pairs of each contrast."""
    parts = " UNION ALL ".join(f"SELECT setting, subject, '{a}-{b}' AS contrast, {a} AS first, {b} AS second FROM w" for a, b in CONTRASTS)
    columns = ", ".join(f"max({value}) FILTER (phase = '{p}') AS {p}" for p in ("Pre", "Stim", "Post"))
    return f"""{gains(chosen, key)}, w AS (
  SELECT setting, subject, {columns} FROM gain WHERE direction = '{direction}' {more} GROUP BY setting, subject
), pair AS (
  SELECT *, first - second AS d FROM ({parts}) WHERE first IS NOT NULL AND second IS NOT NULL
)"""


#: CTEs from beats to a model of two predictors: d (subject, y, x1, x2), res (with e and leverage), coef and infl.
OLS = """mo AS (SELECT subject, phase, avg(sbp) AS sbp, avg(rri) AS rri, count(*) AS size FROM beats GROUP BY ALL),
d AS (SELECT a.subject, a.sbp - b.sbp AS y, a.rri - b.rri AS x1, (a.size - b.size)::DOUBLE AS x2 FROM mo a JOIN mo b ON a.subject = b.subject AND a.phase = 'Stim' AND b.phase = 'Pre'),
su AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y, stddev_samp(y) AS sdy, stddev_samp(x1) AS sd1, stddev_samp(x2) AS sd2 FROM d),
so AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM su),
res AS (SELECT d.*, so.*, y - (my + b1 * (x1 - m1) + b2 * (x2 - m2)) AS e, 1.0 / n + ((x1 - m1) * (x1 - m1) * s22 - 2 * (x1 - m1) * (x2 - m2) * s12 + (x2 - m2) * (x2 - m2) * s11) / det AS leverage,
  ((x1 - m1) * s22 - (x2 - m2) * s12) / det AS w1, ((x2 - m2) * s11 - (x1 - m1) * s12) / det AS w2 FROM d, so),
rex AS (SELECT *, 1.0 / n - m1 * w1 - m2 * w2 AS w0, e / (1 - leverage) AS u, sum(e * e) OVER () AS sse FROM res),
hc AS (SELECT sqrt(sum(w0 * w0 * u * u)) AS h0, sqrt(sum(w1 * w1 * u * u)) AS h1, sqrt(sum(w2 * w2 * u * u)) AS h2 FROM rex),
coef AS (SELECT 'constant' AS term, my - b1 * m1 - b2 * m2 AS b, h0 AS hc3, NULL::DOUBLE AS beta, n FROM so, hc UNION ALL SELECT 'rri', b1, h1, b1 * sd1 / sdy, n FROM so, hc UNION ALL SELECT 'size', b2, h2, b2 * sd2 / sdy, n FROM so, hc),
vr AS (SELECT *, sqrt(greatest(0.0, (sse - e * u) / (n - 4))) AS loo, 1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det AS i00 FROM rex),
infl AS (SELECT subject, n, leverage, u * u * leverage / (3 * sse / (n - 3)) AS cook, w0 * u / (loo * sqrt(i00)) AS dfb_constant, w1 * u / (loo * sqrt(s22 / det)) AS dfb_rri, w2 * u / (loo * sqrt(s11 / det)) AS dfb_size FROM vr)"""


def normal_tail(z: str) -> str:
    """Two-sided tail of the normal distribution: the series of the density times odd powers over double factorials."""
    x = f"greatest(abs({z}), 1e-300)"
    terms = f"list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln({x}) - {x} * {x} / 2 - lgamma(2 * k + 2) + k * ln(2.0) + lgamma(k + 1))))"
    return f"greatest(0.0, 1 - 2 * {terms} / sqrt(2 * pi()))"


def centred(n: int, source: str = "beats", columns: str = "t, rri, sbp") -> str:
    """CTE ``seg``: the ``n`` consecutive beats of each cell whose middle is nearest to the cell's, with their number i from 1."""
    return f"""ca AS (SELECT *, row_number() OVER w AS rn, lead(t, {n - 1}) OVER w AS te, (min(t) OVER (PARTITION BY subject, phase) + max(t) OVER (PARTITION BY subject, phase)) / 2 AS mid
  FROM {source} WINDOW w AS (PARTITION BY subject, phase ORDER BY beat_idx)), cb AS (SELECT *, row_number() OVER (PARTITION BY subject, phase ORDER BY abs((t + te) / 2 - mid), rn) AS kk FROM ca WHERE te IS NOT NULL), cf AS (SELECT subject, phase, rn AS first_rn FROM cb WHERE kk = 1),
seg AS (SELECT ca.subject, ca.phase, ca.rn - cf.first_rn + 1 AS i, {columns} FROM ca JOIN cf USING (subject, phase) WHERE ca.rn BETWEEN cf.first_rn AND cf.first_rn + {n - 1})"""


def peaks(height: float, distance: int, source: str, part: str, order: str) -> str:
    """CTE ``pk``: (part columns, at, sbp) of peaks; starts of level stretches above both neighbours, tallest first within ``distance`` places."""
    return f"""pa AS (SELECT *, row_number() OVER w AS pi, sbp IS DISTINCT FROM lag(sbp) OVER w AS fresh FROM {source} WINDOW w AS (PARTITION BY {part} ORDER BY {order})),
pb AS (SELECT *, lag(sbp) OVER w AS before, lead(sbp) OVER w AS after FROM pa WHERE fresh WINDOW w AS (PARTITION BY {part} ORDER BY pi)),
pc AS (SELECT * FROM pb WHERE sbp > before AND sbp > after AND sbp >= {height}),
pd AS (SELECT {part}, list_reduce(list([pi] ORDER BY sbp DESC, pi), lambda acc, e: CASE WHEN len(list_filter(acc, lambda z: abs(z - e[1]) < {distance})) > 0 THEN acc ELSE list_concat(acc, e) END) AS kept FROM pc GROUP BY {part}),
pk AS (SELECT pc.* FROM pc JOIN pd USING ({part}) WHERE list_contains(pd.kept, pc.pi))"""


def t_tail(t: str, v: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom: the finite series in the angle atan(t / sqrt(v))."""
    c = f"({v} / ({v} + ({t}) * ({t})))"  # squared cosine
    odd = f"coalesce(list_sum(list_transform(range(0, (({v} - 1) // 2)::BIGINT), lambda k: exp(2 * k * ln(2.0) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + k * ln({c})))), 0.0)"
    even = f"coalesce(list_sum(list_transform(range(0, ({v} // 2)::BIGINT), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2.0) - 2 * lgamma(k + 1) + k * ln({c})))), 0.0)"
    angle = f"atan(({t}) / sqrt({v}))"
    return f"(1 - CASE WHEN {v} % 2 = 1 THEN 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) ELSE sin({angle}) * {even} END)"


def rounded(columns: str, digits: int = 6) -> str:
    """``a b c`` as rounded columns of the same names, NaN as null; or one ``expression AS name``."""
    if " AS " in columns:
        expression, _, name = columns.rpartition(" AS ")
        return f"CASE WHEN isnan({expression}::DOUBLE) THEN NULL ELSE round({expression}::DOUBLE, {digits}) END AS {name}"
    return ", ".join(f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE round({c}::DOUBLE, {digits}) END AS {c}" for c in columns.split())
