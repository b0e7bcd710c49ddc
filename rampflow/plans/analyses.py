"""Whole analyses of a beat table: each returns its result tables by name, lazily, after its gate.

``beats`` has subject, phase, beat_idx, t (seconds, may be null), rri and sbp. ``anchors`` are known
results (setting, contrast, mean_difference); where given, they have to be met before anything else.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import stable_seed, with_bh
from ..operators import audit, context, contrasts, decisions, linear, prevalence, ramps, resampling, segment, summaries
from ..operators.grouped import per_group, per_row
from ..operators.kernels import nonlinear, spectral, var
from ..operators.ledger import resumed
from ..operators.resampling import Analysis
from ..schema import BRANCHES, CANONICAL, CELL, FACTORIAL, NEIGHBOURS, OFAT, PHASES, SUBPHASE_CONTRASTS, Neighbours, windows_frame

Tables = dict[str, DataFrame]
#: Names of the two directions, the one towards intervals first.
DIRECTIONS = ("sbp_to_rri", "rri_to_sbp")


def gate(beats: DataFrame, anchors: DataFrame | None, tolerance: float = 1e-9) -> DataFrame:
    """Checks of the input and, where anchors are given, of the canonical result against them."""
    cells = beats.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.max("beat_idx").alias("last"), F.count_distinct("beat_idx").alias("u"))
    checks = [
        audit.check(cells, "dense_index", F.bool_and((F.col("n") == F.col("last")) & (F.col("n") == F.col("u"))), F.count(F.lit(1))),
        audit.check(beats, "valid_values", F.count_if(~segment.valid(F.col("rri"), F.col("sbp"))) == 0, F.count_if(~segment.valid(F.col("rri"), F.col("sbp")))),
    ]
    if anchors is not None:
        found = contrasts.summary(_differences(beats, (replace(CANONICAL, name="canonical"),)), "setting", "contrast")
        checks.append(audit.close(found, anchors, ["setting", "contrast"], ["mean_difference"], tolerance, "anchors"))
    return audit.all_checks(*checks)


def _differences(beats: DataFrame, settings) -> DataFrame:
    g = ramps.gains(beats, settings).where("direction = 'all'").select("setting", *CELL, "gain")
    return contrasts.differences(g, "gain", "setting")


def sequence_analysis(beats: DataFrame, anchors: DataFrame | None = None, times: int = 10_000, seed: int = 20260805) -> Tables:
    """Gains, their contrasts, one-factor and full sweeps, context and omission."""
    checks = gate(beats, anchors)
    audit.require(checks)
    canonical = _differences(beats, (CANONICAL,))
    sweep = contrasts.summary(_differences(beats, FACTORIAL), "setting", "contrast")
    return {
        "checks": checks,
        "sequences": ramps.sequences(beats, (CANONICAL,)),
        "gains": ramps.gains(beats, (CANONICAL,)),
        "contrasts": summaries.phase_contrasts(ramps.gains(beats, (CANONICAL,)).where("direction = 'all'").select("setting", *CELL, "gain"), "gain", "setting", times=times, seed=seed),
        "intervals": contrasts.intervals(canonical, "setting", "contrast", times=times, seed=seed),
        "one_factor": contrasts.summary(_differences(beats, OFAT), "setting", "contrast"),
        "factorial": sweep,
        "factorial_agreement": summaries.sign_agreement(sweep, "setting", CANONICAL.setting_id, "mean_difference", "contrast"),
        "leave_one_out": contrasts.leave_one_out(canonical, "setting", "contrast"),
        "context": context.context(beats),
        "eligible": summaries.mixed_model_eligible(ramps.sequences(beats, (CANONICAL,))),
    }


def branch_analysis(beats: DataFrame, anchors: DataFrame | None = None) -> Tables:
    """The five branches: gains, evaluability, contrasts, agreement with the reference branch, response patterns."""
    checks = gate(beats, anchors)
    audit.require(checks)
    g = ramps.gains(beats, BRANCHES)
    pairs = _differences(beats, BRANCHES)
    first = g.where("setting = 'REF'")
    agreement = [contrasts.bland_altman(first, g.where(F.col("setting") == s.name), "gain", [*CELL, "direction"]).withColumn("setting", F.lit(s.name)) for s in BRANCHES[1:]]
    return {
        "checks": checks,
        "gains": g,
        "missing": summaries.missingness(g, "gain", "setting", "phase", "direction"),
        "contrasts": contrasts.summary(pairs, "setting", "contrast"),
        "rank_tests": contrasts.signed_rank_p(pairs, "setting", "contrast"),
        "agreement": audit.all_checks(*agreement),
    }


#: The branches and the five context figures that sub-phases are compared by; 44 outcomes in all.
SUBPHASE_BRANCHES = ("REF", "A0_MAX", "A1_MAX")
SUBPHASE_CONTEXT = ("mean_sbp", "mean_hr", "mean_rri", "rmssd", "n_beats")
#: Figures of all ramps of a branch, and of its gains by direction.
SUBPHASE_FIGURES = ("n_maximal", "n_ramps", "n_sequences", "bei", "mean_beats", "mean_r2", "mean_r", "mean_sbp_amplitude", "mean_rri_response")


def subphase_outcomes(timed: DataFrame, g: DataFrame) -> DataFrame:
    """(subject, phase, outcome, value): the 44 outcomes of every sub-phase in long form, from its beats and its gains."""
    numbers = context.context(timed).select(*CELL, *[F.col(c).cast("double").alias(c) for c in SUBPHASE_CONTEXT]).unpivot(CELL, list(SUBPHASE_CONTEXT), "outcome", "value")
    g = g.where(F.col("setting").isin(*SUBPHASE_BRANCHES))
    gain = g.select(*CELL, F.concat_ws("_", F.lit("gain"), "setting", "direction").alias("outcome"), F.col("gain").alias("value"))
    whole = g.where("direction = 'all'").withColumn("no_valid", (F.col("n_sequences") == 0).cast("double"))
    names = [*SUBPHASE_FIGURES, "no_valid"]
    more = whole.select(*CELL, "setting", *[F.col(c).cast("double").alias(c) for c in names]).unpivot([*CELL, "setting"], names, "figure", "value")
    return numbers.unionByName(gain).unionByName(more.select(*CELL, F.concat_ws("_", "figure", "setting").alias("outcome"), "value"))


def response_state(contrasts_of: DataFrame) -> DataFrame:
    """Early and late stimulation against late baseline, of pressure, rate, RMSSD and the three gains, by their short names."""
    names = {"mean_sbp": "sbp", "mean_hr": "hr", "rmssd": "rmssd", **{f"gain_{b}_all": b for b in SUBPHASE_BRANCHES}}
    mapped = F.coalesce(*[F.when(F.col("outcome") == k, v) for k, v in names.items()])
    rows = contrasts_of.withColumn("dimension", mapped).where(F.col("dimension").isNotNull() & F.col("contrast").isin("Stim_early-Pre_late", "Stim_late-Pre_late"))
    return rows


def subphase_analysis(beats: DataFrame, times: int = 10_000, seed: int = 20260804, tasks: int = 0) -> Tables:
    """Six half-open sub-phases of timed beats: gains of the branches, 44 outcomes, their six contrasts with intervals and rank tests, and
    the pattern of early against late stimulation. The rank tests are descriptors; nothing is decided by them."""
    timed = segment.in_windows(beats.where("t is not null").drop("phase"), windows_frame(beats.sparkSession, "subphase"))
    timed = timed.select("subject", F.col("window").alias("phase"), "beat_idx", "t", "rri", "sbp")
    # Beats are numbered within their sub-phase.
    timed = timed.withColumn("beat_idx", F.row_number().over(Window.partitionBy(*CELL).orderBy("t", "beat_idx")).cast("int"))
    g = ramps.gains(timed, BRANCHES, tasks=tasks)
    outcomes = subphase_outcomes(timed, g)
    pairs = contrasts.differences(outcomes, "value", "outcome", contrasts=SUBPHASE_CONTRASTS)
    own_seed = stable_seed(seed, F.col("contrast"), F.col("outcome"))
    table = contrasts.summary(pairs, "contrast", "outcome")
    state = response_state(table)
    return {
        "gains": g,
        "context": context.context(timed),
        "outcomes": outcomes,
        "contrasts": table,
        "intervals": contrasts.intervals(pairs.withColumn("seed", own_seed), "contrast", "outcome", times=times, statistics=("mean",)),
        "rank_tests": contrasts.signed_rank_p(pairs, "contrast", "outcome"),
        "response_state": state,
        "pattern": decisions.temporal_pattern(state),
    }


def autoregression_analysis(beats: DataFrame) -> Tables:
    """Causality of every cell both ways, BH within phase and direction, and prevalence over phases."""
    fit = per_group(
        beats, CELL, ["beat_idx"], ["sbp", "rri"], lambda key, s, r: var.analyse(s, r),
        "order int, n_obs int, modulus double, stable boolean, whiteness_p double, normality_p double, f_forward double, p_forward double, f_reverse double, p_reverse double, reason string",
    )
    long = fit.select(*CELL, "reason", F.inline(F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"f_{k}").alias("f"), F.col(f"p_{k}").alias("p")) for d, k in (("sbp_to_rri", "forward"), ("rri_to_sbp", "reverse"))])))
    tests = with_bh(long, "p", "q", "phase", "direction").withColumns({"nominal": F.col("p") < 0.05, "fdr": F.col("q") < 0.05})
    return {
        "fits": fit,
        "tests": tests,
        "prevalence": prevalence.prevalence(tests, "nominal", "direction", "phase"),
        "prevalence_fdr": prevalence.prevalence(tests, "fdr", "direction", "phase"),
        "mcnemar": prevalence.mcnemar_p(prevalence.mcnemar(tests.select("direction", *CELL, "nominal"), "nominal", "direction"), "direction"),
        "cochran": prevalence.cochran(tests.select("direction", *CELL, "nominal"), "nominal", "direction"),
    }


def cell_places(beats: DataFrame) -> DataFrame:
    """(subject, phase, place): places from 0 of all phases of all subjects, by subject and then in order of the phases."""
    nth = F.row_number().over(Window.orderBy("subject")) - 1  # a row a subject
    subjects = beats.select("subject").distinct().withColumn("_nth", nth)
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(i).alias("i")) for i, p in enumerate(PHASES)])
    return subjects.select("subject", "_nth", F.inline(phases)).select("subject", "phase", (F.col("_nth") * len(PHASES) + F.col("i")).alias("place"))


def spawned_seed(master: int, place: int) -> int:
    """The first word of the child that a master seed sequence spawns at a place."""
    return int(np.random.SeedSequence(master, spawn_key=(place,)).generate_state(1, np.uint32)[0])


def coherence_analysis(beats: DataFrame, surrogates: int = 1_000, seed: int = 20260805, **options) -> Tables:
    """Coherence of every cell with its surrogate test and prevalence. Needs times.

    A cell's stream is the child of the seed at its place among all phases of all subjects, so that a cell that is missing changes no
    other's.
    """
    def kernel(key, place, t, s, r):
        a, b = spectral.resample(t, [s, r])[1]
        return spectral.coherence_test(a, b, surrogates, spawned_seed(seed, int(place[0])), **options)

    placed = beats.where("t is not null").join(F.broadcast(cell_places(beats)), CELL)
    cells = per_group(placed, CELL, ["t"], ["place", "t", "sbp", "rri"], kernel, "observed double, edge double, p double, hits long")
    cells = with_bh(cells, "p", "q", "phase").withColumns({"nominal": F.col("p") < 0.05, "fdr": F.col("q") < 0.05})
    return {
        "cells": cells,
        "contrasts": contrasts.summary(contrasts.differences(cells, "observed"), "contrast"),
        "prevalence": prevalence.prevalence(cells, "nominal", "phase"),
        "mcnemar": prevalence.mcnemar_p(prevalence.mcnemar(cells, "nominal")),
        "cochran": prevalence.cochran(cells, "nominal"),
    }


def coherence_sensitivity(beats: DataFrame, rate: float = 4.0, band: tuple[float, float] = (0.08, 0.12), reference: DataFrame | None = None) -> Tables:
    """Coherence with segments of 512 and of 256 samples side by side, and the seven conditions that would speak against the longer ones.

    ``reference(subject, phase, coherence)`` are known results of the longer segments, to be met to 1e-12.
    """
    options = {n: {"size": n, "overlap": n // 2, "rate": rate, "band": band} for n in (512, 256)}
    drift = [k for k in options[512] if k not in ("size", "overlap") and options[512][k] != options[256][k]]

    def kernel(key, t, s, r):
        a, b = spectral.resample(t, [s, r], rate)[1]
        return [(n, spectral.segment_count(len(a), n, n // 2), spectral.coherence(a, b, **o)) for n, o in options.items()]

    spectral.check_options(512, 256, rate, band)
    cells = per_group(beats.where("t is not null"), CELL, ["t"], ["t", "sbp", "rri"], kernel, "size int, segments int, coherence double")
    pairs = contrasts.differences(cells, "coherence", "size")
    table = contrasts.summary(pairs, "size", "contrast").join(contrasts.signed_rank_p(pairs, "size", "contrast").select("size", "contrast", "p"), ["size", "contrast"])
    main = table.where("contrast = 'Stim-Pre'")
    one = lambda c, n: F.max(F.when(F.col("size") == n, F.col(c)))
    checks = audit.all_checks(
        audit.check(main, "no_effect_with_short_segments", one("p", 256) >= 0.05, one("p", 256)),
        audit.check(main, "small_effect_with_short_segments", F.abs(one("dz", 256)) < 0.5, one("dz", 256)),
        audit.check(main, "same_direction", F.signum(one("mean_difference", 512)) == F.signum(one("mean_difference", 256)), one("mean_difference", 256)),
        audit.check(main, "same_interpretation", (one("p", 512) >= 0.05) == (one("p", 256) >= 0.05), one("p", 512)),
        audit.check(cells, "all_cells_estimated", F.count("coherence") == F.count(F.lit(1)), F.count("coherence")),
        audit.check(cells, "only_segment_length_differs", F.count(F.lit(1)).isNotNull() & F.lit(not drift), F.max(F.lit(",".join(drift)))),
    )
    if reference is not None:
        checks = audit.all_checks(checks, audit.close(cells.where("size = 512"), reference, CELL, ["coherence"], 1e-12, "reference_reproduced"))
    return {"cells": cells, "contrasts": table, "checks": checks}


def coherence_validation(spark, simulations: int = 200, surrogates: int = 199, seed: int = 20260806) -> DataFrame:
    """False-positive rate without coupling (its exact interval has to hold 0.05) and detection with it (at least 0.80).

    Every simulation has a stream of its own, from the seed, scenario and number.
    """
    jobs = spark.range(simulations).crossJoin(spark.createDataFrame([("uncoupled", 0), ("shared", 1)], "scenario string, coupled int"))

    def kernel(key, i, coupled):
        a, b = spectral.coloured_pair(bool(coupled[0]), np.random.default_rng([seed, int(coupled[0]), int(i[0])]))
        return (spectral.coherence_test(a, b, surrogates, [seed, 7, int(coupled[0]), int(i[0])])[2] < 0.05,)

    rows = per_group(jobs.repartition(spark.sparkContext.defaultParallelism, "id"), ["scenario", "id"], ["id"], ["id", "coupled"], kernel, "detected boolean")
    rate = prevalence.prevalence(rows, "detected", "scenario")
    passed = F.when(F.col("scenario") == "uncoupled", (F.col("low") <= 0.05) & (F.col("high") >= 0.05)).otherwise(F.col("share") >= 0.80)
    return rate.withColumn("passed", passed)


#: Partitions a core over which jobs of whole phases are dealt.
JOBS = 16


def coupling_sensitivity(beats: DataFrame, settings=NEIGHBOURS, methods: tuple[str, ...] = ("CE", "LP")) -> Tables:
    """Neighbour estimators under one-factor settings, their Stim-Pre effects, and whether they agree in sign with the primary one.

    The same-beat convention holds for pressure to interval alone. A cell, setting, method and direction is a job of its own.
    """
    by_name = {s.name: s for s in settings}
    job = [*CELL, "setting", "method", "direction"]

    def kernel(key, p, r):
        s, method, name = by_name[key[-3]], *key[-2:]
        p, r = nonlinear.standardise(p), nonlinear.standardise(r)
        target, source = (r, p) if name == DIRECTIONS[0] else (p, r)
        e = nonlinear.estimate(method, target, source, k=s.k, depth=s.depth, source_now=s.source_now and name == DIRECTIONS[0])
        return e["strength"], e["reason"]

    def run(length):
        rows = segment.centred(beats, length) if length else beats
        packed = rows.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("beat_idx", "sbp", "rri"))).alias("_rows"))
        for column, of in zip(job[-3:], ([s.name for s in settings if s.length == length], methods, DIRECTIONS), strict=True):
            packed = packed.withColumn(column, F.explode(F.array(*map(F.lit, of))))
        # Of whole phases a job takes long: so many partitions that few jobs share one.
        jobs = packed.repartition((2 if length else JOBS) * beats.sparkSession.sparkContext.defaultParallelism, *job)
        series = lambda v: F.transform("_rows", lambda x: x[v].cast("double")).alias(v)
        return per_row(jobs.select(*job, series("sbp"), series("rri")), job, kernel, "strength double, reason string")

    cells = reduce(DataFrame.unionByName, map(run, dict.fromkeys(s.length for s in settings)))
    pairs = contrasts.differences(cells.drop("reason"), "strength", "setting", "method", "direction", contrasts=(("Stim", "Pre"),))
    effects = contrasts.summary(pairs, "setting", "method", "direction")
    return {"cells": cells, "effects": summaries.sign_agreement(effects, "setting", settings[0].name, "mean_difference", "method", "direction")}


def coupling_analysis(beats: DataFrame, methods: tuple[str, ...] = ("CE", "LP", "SSC"), length: int = 256, shifts: int = 0, times: int = 10_000, seed: int = 20260807) -> Tables:
    """Neighbour estimators on centred segments both ways, their contrasts, and surrogate tests if ``shifts`` are asked for.

    Cells without times take the running sum of intervals as time, which is an approximation.
    """
    upto = Window.partitionBy(*CELL).orderBy("beat_idx").rowsBetween(Window.unboundedPreceding, 0)
    timed = beats.withColumn("t", F.coalesce("t", F.sum("rri").over(upto) / 1000.0))

    def kernel(key, s, r):
        s, r, out = nonlinear.standardise(s), nonlinear.standardise(r), []
        for method in methods:
            for i, (name, target, source) in enumerate((("sbp_to_rri", r, s), ("rri_to_sbp", s, r))):
                e = nonlinear.estimate(method, target, source)
                p, edge, hit = nonlinear.shift_test(method, target, source, shifts, [seed, i, *map(ord, "/".join(key))]) if shifts else (None, None, None)
                out.append((method, name, e["strength"], e["reduced"], e["full"], "|".join(e["embedding"]), int(e["n_vectors"]), e["reason"], p, edge, hit))
        return out

    cells = per_group(
        segment.centred(timed, length), CELL, ["beat_idx"], ["sbp", "rri"], kernel,
        "method string, direction string, strength double, reduced double, full double, embedding string, n_vectors int, reason string, p double, edge double, significant boolean",
    )
    return {
        "cells": cells,
        "missing": summaries.missingness(cells, "strength", "method", "direction", "phase"),
        "contrasts": summaries.phase_contrasts(cells.select("method", "direction", *CELL, "strength"), "strength", "method", "direction", times=times, seed=seed),
    }


#: Shifts of one job; a cell's surrogates are dealt over so many tasks as they need.
SHIFTS_PER_JOB = 50
SHIFT_JOB = ["input", *CELL, "method", "direction", "block"]


def shift_jobs(segments: DataFrame, methods: tuple[str, ...], count: int, seed: int, setting: Neighbours) -> DataFrame:
    """A row for every cell, method, direction and block of shifts, with its series and a hash of all that the result depends on."""
    spark = segments.sparkSession
    packed = segments.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("beat_idx", "sbp", "rri"))).alias("rows"))  # at most one centred segment
    options = f"{count}|{seed}|{setting.k}|{setting.depth}|{setting.source_now}|{SHIFTS_PER_JOB}"
    packed = packed.withColumn("input", F.sha2(F.concat_ws("|", F.to_json("rows"), F.lit(options)), 256))
    ways = [(m, d, b) for m in methods for d in DIRECTIONS for b in range(-(-count // SHIFTS_PER_JOB))]
    ways = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(d).alias("direction"), F.lit(b).alias("block")) for m, d, b in ways])

    def series(c: str):
        return F.transform("rows", lambda r: r[c].cast("double")).alias(c)

    return packed.select("input", *CELL, F.inline(ways), series("sbp"), series("rri"))


def shift_tests(segments: DataFrame, methods: tuple[str, ...] = ("LP", "CE", "SSC"), count: int = 199, seed: int = 20260807, setting: Neighbours = NEIGHBOURS[0], ledger: str | None = None) -> DataFrame:
    """Both directions of every cell against circular shifts of the source: strength, 95 % point, p, significant.

    A job is one cell, method, direction and block of shifts, which shares what depends on the target alone; the first block
    has the strength as it is too. A cell's shifts are drawn from a stream of its own, all of them in every job, so that the result does
    not depend on the blocks. With ``ledger``, a path that executors share, finished jobs are kept there and a run
    that was stopped goes on with the others. Any failed estimate makes the test null and not evaluable; ``reason`` names the failures.
    """
    spark = segments.sparkSession
    options = {"k": setting.k, "depth": setting.depth}

    def kernel(key, p, r):
        _, *cell, method, direction, block = key
        p, r = nonlinear.standardise(p), nonlinear.standardise(r)
        target, source = (r, p) if direction == DIRECTIONS[0] else (p, r)
        more = {} if method == "SSC" else options | {"source_now": setting.source_now and direction == DIRECTIONS[0]}
        try:
            rng = np.random.default_rng([seed, ["LP", "CE", "SSC"].index(method), int(direction == DIRECTIONS[1]), *map(ord, "/".join(cell))])
            shifts = nonlinear.shift_offsets(len(source), count, rng)
        except ValueError as why:
            return None, [], [str(why)]
        some = [0] * (not block) + list(shifts[int(block) * SHIFTS_PER_JOB :][:SHIFTS_PER_JOB])
        made = nonlinear.shifted(method, target, source, some, **more)
        seen = made.pop(0)["strength"] if not block else None
        good = [e["strength"] for e in made if np.isfinite(e["strength"])]
        return seen, good, sorted({e["reason"] for e in made} - {"NA"})

    def run(jobs: DataFrame) -> DataFrame:
        dealt = jobs.repartition(2 * spark.sparkContext.defaultParallelism, *SHIFT_JOB)
        return per_row(dealt.select(*SHIFT_JOB, "sbp", "rri"), SHIFT_JOB, kernel, "seen double, shifted array<double>, failures array<string>")

    jobs = shift_jobs(segments, methods, count, seed, setting)
    null = resumed(jobs, SHIFT_JOB, run, ledger) if ledger else run(jobs)
    values = F.sort_array(F.flatten(F.collect_list("shifted")))  # ``count`` values at most
    out = null.groupBy(*CELL, "method", "direction").agg(F.max("seen").alias("strength"), values.alias("_null"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("failures")))).alias("_why"))
    n = F.size("_null")
    whole = (n == count) & F.col("strength").isNotNull()
    edge = F.when(whole, F.col("_null")[int(np.ceil(0.95 * (count - 1)))])
    hits = F.size(F.filter("_null", lambda x: x >= F.col("strength")))
    out = out.withColumns({"n_finite": n, "edge": edge, "p": F.when(whole, (1 + hits) / (1 + count)), "evaluable": whole, "reason": F.when(F.size("_why") > 0, F.array_join("_why", ";")).otherwise("NA")})
    return out.withColumn("significant", F.coalesce(F.col("strength") > F.col("edge"), F.lit(False))).drop("_null", "_why")


def coupling_validation(spark, replicates: int = 200, shifts: int = 39, n: int = 256, methods: tuple[str, ...] = ("LP", "CE", "SSC"), seed: int = 20260807) -> Tables:
    """The neighbour estimators on simulated pairs of known coupling, a shift test where there is none, and the gate.

    A job is one scenario, noise, replicate and method; the whole has 5 x 2 x 200 x 3 of them.
    """
    grid = [(s, i, m) for s in nonlinear.SCENARIOS for i in range(len(nonlinear.NOISES)) for m in methods]
    jobs = spark.createDataFrame(grid, "scenario string, level int, method string").crossJoin(spark.range(replicates).withColumnRenamed("id", "replicate"))
    jobs = jobs.repartition(4 * spark.sparkContext.defaultParallelism, "scenario", "level", "method", "replicate").withColumn("one", F.lit(1.0))
    names = list(nonlinear.SCENARIOS)

    def kernel(key, _):
        scenario, level, method, replicate = key
        x, y = nonlinear.simulate(scenario, int(level), int(replicate), seed, n)
        out, hits = [nonlinear.estimate(method, y, x)["strength"], nonlinear.estimate(method, x, y)["strength"]], [None, None]
        if scenario == "uncoupled_linear":
            for i, (target, source) in enumerate(((y, x), (x, y))):
                p = nonlinear.shift_test(method, target, source, shifts, [seed, 200, names.index(scenario), int(level), int(replicate), i])[0]
                hits[i] = bool(p < 0.05) if np.isfinite(p) else None
        return *out, *hits

    rows = per_group(jobs, ["scenario", "level", "method", "replicate"], ["one"], ["one"], kernel, "forward double, reverse double, forward_hit boolean, reverse_hit boolean")
    rows = rows.withColumn("noise", F.array(*[F.lit(x) for x in nonlinear.NOISE_NAMES])[F.col("level")]).drop("level")
    summary = decisions.validation_summary(rows)
    return {"rows": rows, "summary": summary, "gate": decisions.method_gate(summary)}


def association_analysis(changes: DataFrame, times: int = 10_000, permutations: int = 100_000, seed: int = 20260801, intervals: bool = True) -> Tables:
    """How changes of gain follow changes of pressure over participants, from rows (method, subject, x, y, pre, stim).

    Statistics with bootstrap intervals and a permutation test (the dear part, left out without ``intervals``), each
    participant left out, robust models of the gain under stimulation adjusted for the one before, influence, residual tests,
    and the class of the association. One study's participants are one array, and its draws are dealt over tasks.
    """
    rho = contrasts.correlations(changes, "x", "y", "method")
    omitted = contrasts.leave_one_out_correlations(changes, "x", "y", "method")
    ref = changes.where("method = 'REF'")
    whole = lambda c: (F.col(c) - F.avg(c).over(_all)) / F.stddev_samp(c).over(_all)
    _all = Window.partitionBy("method")
    raw = linear.fit(ref, ["method"], "stim", ["pre", "x"])
    scaled = linear.fit(ref.select("method", "subject", *[whole(c).alias(c) for c in ("stim", "pre", "x")]), ["method"], "stim", ["pre", "x"])
    simple = linear.fit(ref, ["method"], "y", ["x"])
    slope = linear.coefficients(raw).where("term = 'x'").select("b")
    out = {
        "rho": rho,
        "leave_one_out": omitted,
        "models": linear.coefficients(raw).withColumn("model", F.lit("raw")).unionByName(linear.coefficients(scaled).withColumn("model", F.lit("standardised"))),
        "influence": simple.rows.select("method", "subject", "leverage", "cook", "large").withColumn("model", F.lit("simple")).unionByName(raw.rows.select("method", "subject", "leverage", "cook", "large").withColumn("model", F.lit("adjusted"))),
        "residuals": linear.residual_tests(raw, "subject"),
        "partial": contrasts.partial_spearman(ref, "x", "stim", "pre", "method"),
        "classification": decisions.association_class(rho.select("method", "n", "rho"), omitted.select("method", "rho"), slope),
    }
    if intervals:

        analyses = (Analysis("spearman", times), Analysis("permutation", permutations), Analysis("theil_sen", times))
        drawn = resampling.paired(ref, ["method"], "subject", "x", "y", analyses, seed)
        drawn = drawn.unionByName(resampling.paired(changes.where("method <> 'REF'"), ["method"], "subject", "x", "y", analyses[:1], seed))
        tested = drawn.where("analysis = 'permutation'").select("method", F.col("p").alias("permutation_p"))
        drawn = drawn.where("analysis <> 'permutation'").drop("p").join(tested, "method", "left")
        drawn = drawn.withColumn("permutation_p", F.when(F.col("analysis") == "spearman", F.col("permutation_p"))).select("method", "analysis", "estimate", "low", "high", "permutation_p")
        drawn = drawn.join(rho.select("method", "n", F.col("rho_p").alias("p")), "method").withColumn("p", F.when(F.col("analysis") == "spearman", F.col("p")))
        linear_r = contrasts.pearson_ci(changes, "x", "y", "method").join(rho.select("method", F.col("r_p").alias("p")), "method")
        linear_r = linear_r.select("method", F.lit("pearson").alias("analysis"), F.col("r").alias("estimate"), "low", "high", F.lit(None).cast("double").alias("permutation_p"), "n", "p")
        out["statistics"] = drawn.unionByName(linear_r)
    return out


#: The eight outcomes of the context family.
CONTEXT_FAMILY = ("n_beats", "mean_rri", "mean_hr", "mean_sbp", "sd_sbp", "sd_rri", "rmssd", "hf_power")


def context_family(beats: DataFrame, band: tuple[float, float] = (0.15, 0.40), times: int = 10_000) -> Tables:
    """Eight context outcomes of every cell, their contrasts with BH over the eight within each contrast, and checks. Needs times."""
    def kernel(key, t, r):
        return (spectral.band_power(spectral.resample(t, [r])[1][0], *band),)

    power = per_group(beats.where("t is not null"), CELL, ["t"], ["t", "rri"], kernel, "hf_power double")
    cells = context.context(beats).join(power, CELL, "left").select(*CELL, *CONTEXT_FAMILY)
    long = cells.select(*CELL, *[F.col(c).cast("double").alias(c) for c in CONTEXT_FAMILY]).unpivot(CELL, list(CONTEXT_FAMILY), "metric", "value")
    pairs = contrasts.differences(long, "value", "metric")
    table = contrasts.summary(pairs, "metric", "contrast").join(contrasts.signed_rank_p(pairs, "metric", "contrast"), ["metric", "contrast"])
    table = with_bh(table, "p", "q", "contrast")
    found = F.array_sort(F.collect_set("metric"))
    n = beats.select(*CELL).distinct().agg(F.count(F.lit(1)).alias("want"))
    return {
        "cells": cells,
        "phases": context.descriptives(long, "value", "metric", "phase"),
        "contrasts": table,
        "checks": audit.all_checks(
            audit.check(long, "exact_family", found == F.array(*[F.lit(c) for c in sorted(CONTEXT_FAMILY)]), F.array_join(found, ",")),
            audit.check(cells.crossJoin(n), "one_row_a_cell", F.count(F.lit(1)) == F.max("want"), F.count(F.lit(1))),
            audit.check(table.groupBy("contrast").count(), "family_of_eight", F.bool_and(F.col("count") == len(CONTEXT_FAMILY)), F.max("count")),
        ),
    }


def resampled_causality(beats: DataFrame, highest: int = 12) -> Tables:
    """Causality on splines at 4 Hz with orders from 0 on: cells of order zero have no test. BH within phase and direction, prevalence."""
    def kernel(key, t, s, r):
        s, r = spectral.resample(t, [s, r])[1]
        return var.analyse(s, r, 0, highest, positive=False) | {"coherence": spectral.coherence(s, r) if len(s) else None}

    fit = per_group(
        beats.where("t is not null"), CELL, ["t"], ["t", "sbp", "rri"], kernel,
        "order int, n_obs int, modulus double, stable boolean, whiteness_p double, normality_p double, f_forward double, p_forward double, f_reverse double, p_reverse double, reason string, coherence double",
    )
    ways = F.array(*[F.struct(F.lit(d).alias("direction"), F.col(f"f_{k}").alias("f"), F.col(f"p_{k}").alias("p")) for d, k in (("sbp_to_rri", "forward"), ("rri_to_sbp", "reverse"))])
    tests = with_bh(fit.select(*CELL, "order", "modulus", "stable", "reason", F.inline(ways)), "p", "q", "phase", "direction")
    tests = tests.withColumns({"nominal": F.when(F.col("stable"), F.col("p") < 0.05), "fdr": F.col("q") < 0.05})
    return {"fits": fit, "tests": tests, "prevalence": prevalence.prevalence(tests, "nominal", "direction", "phase")}
