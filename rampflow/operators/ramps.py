"""Monotone ramps, sequences and gains, as window functions and grouped regressions.

One hash partitioning by cell serves alignment, steps, islands, ramps, their parts and the gains: there is no
self-join, no second read of the beats and no other exchange, and detection is shared by all settings of equal lag and
step rule. The first beat of a cell goes along as a marker, so that cells without ramps have their rows in the gain table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite, ratio, text_array
from ..schema import CELL, Setting, settings_frame

SCAN = ["lag", "least_step", "strict_step"]
#: Beats of a cell that are packed together where sequences take theirs.
BLOCK = 128
#: Beats of a cell that a task takes at once where cells are worked on in blocks.
SPAN = 1 << 16


def aligned(beats: DataFrame, lags: list[int], cell: list[str] = CELL) -> DataFrame:
    """Pressure of beat i with the interval of beat i + lag, for every lag; the last ``lag`` beats have none."""
    w = Window.partitionBy(*cell).orderBy("beat_idx")
    pairs = [F.struct(F.lit(k).alias("lag"), F.lead("rri", k).over(w).alias("rri"), F.lead("beat_idx", k).over(w).isNotNull().alias("_has")) for k in lags]
    out = beats.withColumn("_pairs", F.array(*pairs)).drop("rri").withColumn("_p", F.explode("_pairs")).where("_p._has")
    return out.select(*cell, "beat_idx", "sbp", F.col("_p.lag").alias("lag"), F.col("_p.rri").alias("rri"))


def _rules(settings: tuple[Setting, ...]) -> list[tuple]:
    """A row a step rule: lag, least step, strictness, fewest beats of a part (null if none is wanted), and whether whole ramps are."""
    by: dict[tuple, list[Setting]] = {}
    for s in settings:
        by.setdefault((s.lag, float(s.least_step), s.strict_step), []).append(s)
    return [(*k, min((s.least_beats for s in own if s.overlap), default=None), any(not s.overlap for s in own)) for k, own in by.items()]


def _in_blocks(beats: DataFrame, furthest: int, cell: list[str]) -> DataFrame:
    """``beats`` with ``_block``, ``SPAN`` beats of a cell; a block has the two beats before its own and those that its lags reach too (not ``_own``)."""
    at = F.col("beat_idx") - 1
    reach = F.sequence(F.floor(F.greatest(at - max(furthest, 1), F.lit(0)) / SPAN), F.floor((at + 2) / SPAN))
    return beats.select(*cell, "beat_idx", "rri", "sbp", F.explode(reach).alias("_block")).withColumn("_own", F.floor(at / SPAN) == F.col("_block"))


def steps(beats: DataFrame, settings: tuple[Setting, ...], cell: list[str] = CELL, tasks: int = 0) -> DataFrame:
    """Steps between neighbours with their direction under each step rule of the settings, and islands, by their first step's number.

    The first beat of every cell is a row too, with neither direction nor island. Whether a step is one doesn't depend on the lag, so a cell
    is sorted once for all rules. A ramp of one step is left out where no setting wants it. With ``tasks`` beats count from 1 without
    gaps in every cell, cells are worked on in blocks, dealt over so many tasks, and an island that began in an earlier block has its number from there.
    """
    rules = _rules(settings)
    kinds = list(dict.fromkeys(r[1:3] for r in rules))
    lags = sorted({r[0] for r in rules})
    rows = _in_blocks(beats, lags[-1], cell).repartition(tasks, *cell, "_block") if tasks else beats.select(*cell, "beat_idx", "rri", "sbp", F.lit(True).alias("_own"))
    w = Window.partitionBy(*cell, *["_block"][: tasks]).orderBy("beat_idx")
    rows = rows.withColumns({"_sbp": F.lag("sbp").over(w), "_idx": F.col("beat_idx") - 1 if tasks else F.row_number().over(w) - 1})
    rows = rows.withColumns({f"_rri_{k}": (F.lead("rri", k) if k >= 0 else F.lag("rri", -k)).over(w) for k in {*lags, *(k - 1 for k in lags)}} | {f"_has_{k}": F.lead("beat_idx", k).over(w).isNotNull() for k in lags})
    d = F.col("sbp") - F.col("_sbp")
    for i, (least, strict) in enumerate(kinds):
        big = F.abs(d) > least if strict else F.abs(d) >= least
        rows = rows.withColumn(f"_up_{i}", F.when(finite(d) & (d != 0) & big, d > 0))
        up, before, after = F.col(f"_up_{i}"), F.lag(f"_up_{i}").over(w), F.lead(f"_up_{i}").over(w)
        rows = rows.withColumns({f"_first_{i}": up.isNotNull() & ~up.eqNullSafe(before), f"_alone_{i}": ~up.eqNullSafe(before) & ~up.eqNullSafe(after)})
    starts = {f"_start_{i}": F.when(F.col(f"_first_{i}") & F.col("_own"), F.col("_idx")) for i in range(len(kinds))}
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    if tasks:
        ends = rows.groupBy(*cell, "_block").agg(*[F.max(c).alias(k) for k, c in starts.items()])
        earlier = Window.partitionBy(*cell).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over a row a block
        ends = ends.select(*cell, "_block", *[F.max(k).over(earlier).alias(f"_carry{k}") for k in starts])
        rows = rows.withColumns({k: F.max(c).over(upto) for k, c in starts.items()}).where("_own").join(F.broadcast(ends), [*cell, "_block"])
        starts = {k: F.coalesce(k, f"_carry{k}") for k in starts}
    else:
        starts = {k: F.max(c).over(upto) for k, c in starts.items()}
    rows = rows.withColumns(starts)
    single = F.lit(all(s.least_beats > 2 for s in settings))
    each = []
    for lag, least, strict, lapped, plain in rules:
        i = kinds.index((least, strict))
        up = F.col(f"_up_{i}")
        wanted = up.isNotNull() & F.col(f"_has_{lag}") & ~(single & F.col(f"_alone_{i}"))
        step = {
            "lag": F.lit(lag), "least_step": F.lit(least), "strict_step": F.lit(strict), "_lapped": F.lit(lapped).cast("int"), "_plain": F.lit(plain), "rri": F.col(f"_rri_{lag}"), "_rri": F.col(f"_rri_{lag - 1}"),
            "direction": F.when(up, "up").when(~up, "down"), "_first": F.col(f"_first_{i}"), "_island": F.when(up.isNotNull(), F.col(f"_start_{i}")),
        }
        each.append(F.when(wanted | (F.col("_idx") == 0), F.struct(*[c.alias(k) for k, c in step.items()])))
    return rows.select(*cell, "_idx", "sbp", "_sbp", F.explode(F.array(*each)).alias("_s")).where("_s is not null").select(*cell, "_idx", "sbp", "_sbp", "_s.*")


def _above(move: Column, least: float) -> Column:
    return F.coalesce(finite(move) & (move > least), F.lit(False))


def _gates(settings: tuple[Setting, ...]) -> list[float]:
    """The steps of intervals that some setting wants all of a ramp's to exceed."""
    return sorted({0.0, *(s.least_rri_step or 0.0 for s in settings)})


_MEASURED = [*SCAN, "overlap", "direction", "maximal_start", "start_idx", "end_idx", "n_beats", "sbp_start", "sbp_end", "rri_start", "rri_end", "r", "slope", "concordant"]


def whole(beats: DataFrame, settings: tuple[Setting, ...], cell: list[str] = CELL, tasks: int = 0) -> DataFrame:
    """Maximal ramps, measured in one hash aggregation of the steps, without arrays; and a marker a cell and step rule.

    A ramp is its steps' own beats and the beat before the first. That one beat joins the steps' moments by the
    update of a mean and its sum of squares by one value. ``gate_i`` says of the i-th of the wanted steps whether all of the
    ramp's interval steps exceed it in the ramp's direction, ``concordant`` whether all are 1 or more.
    """
    s = steps(beats, settings, cell, tasks)
    sign = F.when(F.col("direction") == "up", 1.0).otherwise(-1.0)
    first = lambda c: F.max(F.when(F.col("_first"), F.col(c)))
    g = s.groupBy(*cell, *SCAN, "direction", "_island").agg(
        F.count(F.lit(1)).alias("_n"),
        (F.min("_idx") - 1).alias("start_idx"),
        F.max("_idx").alias("end_idx"),
        first("_sbp").alias("sbp_start"),
        first("_rri").alias("rri_start"),
        F.max("sbp").alias("_highest"),
        F.min("sbp").alias("_lowest"),
        F.max_by("rri", "_idx").alias("rri_end"),
        F.avg("sbp").alias("_x"),
        F.avg("rri").alias("_y"),
        F.var_pop("sbp").alias("_xx"),
        F.var_pop("rri").alias("_yy"),
        F.covar_pop("sbp", "rri").alias("_xy"),
        F.min(sign * (F.col("rri") - F.col("_rri"))).alias("_move"),
        (F.count_if(~finite(F.col("rri"))) + F.count_if(F.col("_first") & ~finite(F.col("_rri")))).alias("_odd"),
    )
    n, dx, dy, fine = F.col("_n"), F.col("sbp_start") - F.col("_x"), F.col("rri_start") - F.col("_y"), F.col("_odd") == 0
    xx, yy, xy = (n * F.col(c) + n / (n + 1) * d for c, d in (("_xx", dx * dx), ("_yy", dy * dy), ("_xy", dx * dy)))
    move = F.when(fine, F.col("_move"))
    g = g.withColumns(
        {
            "overlap": F.lit(False),
            "maximal_start": F.col("start_idx"),
            "n_beats": (n + 1).cast("int"),
            "sbp_end": F.when(F.col("direction") == "up", F.col("_highest")).otherwise(F.col("_lowest")),  # steps all go one way
            "r": F.when(fine, ratio(xy, F.sqrt(xx) * F.sqrt(yy))),
            "slope": F.when(fine, ratio(xy, xx)),
            "concordant": F.coalesce(finite(move) & (move >= 1.0), F.lit(False)),
            **{f"gate_{i}": _above(move, x) for i, x in enumerate(_gates(settings))},
        }
    )
    return g.select(*cell, *_MEASURED, *[f"gate_{i}" for i in range(len(_gates(settings)))])


def swept(beats: DataFrame, settings: tuple[Setting, ...], cell: list[str] = CELL, tasks: int = 0) -> DataFrame:
    """Maximal ramps and, where some setting of the step rule wants ``overlap``, all contiguous parts of a ramp; and markers.

    A running sum over a ramp's steps holds the moments of its beats up to each, less the ramp's first beat. A
    part's are the difference of two of them, and whether all of its interval steps exceed a limit is a difference of two
    counts; so a part costs one entry whatever its length, and no beats are copied.
    """
    gates = _gates(settings)
    s = steps(beats, settings, cell, tasks)
    s = s.repartition(tasks, *cell, *SCAN, "_island") if tasks else s
    ramp = Window.partitionBy(*cell, *SCAN, "_island")
    upto = ramp.orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    origin = lambda c: F.first(c).over(upto)
    s = s.withColumns({"_x0": origin("_sbp"), "_y0": origin("_rri"), "_n": F.row_number().over(ramp.orderBy("_idx")), "_last": F.col("_idx") == F.max("_idx").over(ramp)})
    base = F.when(finite(F.col("_y0")), F.col("_y0")).otherwise(0.0)
    s = s.withColumns({"_dx": F.col("sbp") - F.col("_x0"), "_dy": F.when(finite(F.col("rri")), F.col("rri") - base).otherwise(0.0)})
    move = F.when(F.col("direction") == "up", 1.0).otherwise(-1.0) * (F.col("rri") - F.col("_rri"))
    moments = {"x": F.col("_dx"), "y": F.col("_dy"), "xx": F.col("_dx") * F.col("_dx"), "yy": F.col("_dy") * F.col("_dy"), "xy": F.col("_dx") * F.col("_dy")}
    fails = {"odd": ~finite(F.col("rri")), "slow": ~F.coalesce(finite(move) & (move >= 1.0), F.lit(False)), **{f"g{i}": ~_above(move, v) for i, v in enumerate(gates)}}
    s = s.withColumns({f"_s_{k}": F.sum(v).over(upto) for k, v in moments.items()} | {f"_f_{k}": F.sum(v.cast("int")).over(upto) for k, v in fails.items()})

    # A start: its place, values, the moments of all beats before it and the failures of all steps up to it.
    here = F.struct(
        F.col("_idx").alias("i"), F.col("_n").alias("n"), F.col("sbp").alias("sbp"), F.col("rri").alias("rri"),
        *[(F.col(f"_s_{k}") - v).alias(k) for k, v in moments.items()],
        (F.col("_f_odd") - fails["odd"].cast("int")).alias("odd"), *[F.col(f"_f_{k}").alias(k) for k in fails if k != "odd"],
    )
    # The ramp's first beat is before its first step; if it is no number, no part that begins there is.
    opening = F.struct(
        (F.col("_idx") - F.col("_n")).alias("i"), F.lit(0).alias("n"), F.col("_x0").alias("sbp"), F.col("_y0").alias("rri"),
        *[F.lit(0.0).alias(k) for k in moments], F.when(finite(F.col("_y0")), 0).otherwise(-1).alias("odd"), *[F.lit(0).alias(k) for k in fails if k != "odd"],
    )
    lapped = F.col("_lapped").isNotNull()
    earlier = F.collect_list(F.when(lapped, here)).over(ramp.orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumns({"_opening": opening, "_earlier": earlier})
    some = F.filter(F.concat(F.array("_opening"), F.col("_earlier")), lambda b: F.col("_n") - b["n"] + 1 >= F.col("_lapped"))
    of = lambda b, kind: F.struct(b.alias("b"), F.lit(kind).alias("overlap"))
    marker = F.array(of(F.col("_opening"), True), of(F.col("_opening"), False))
    none = F.filter(marker, lambda b: F.lit(False))
    found = F.concat(F.when(lapped, F.transform(some, lambda b: of(b, True))).otherwise(none), F.when(F.col("_plain") & F.col("_last"), F.array(of(F.col("_opening"), False))).otherwise(none))
    s = s.withColumn("_c", F.explode(F.when(F.col("direction").isNull(), marker).otherwise(found)))
    b = lambda k: F.col(f"_c.b.{k}")
    n = F.col("_n") - b("n") + 1
    sx, sy, sxx, syy, sxy = (F.col(f"_s_{k}") - b(k) for k in moments)
    # What is left of a sum of squares below its rounding is nothing.
    spread = lambda q, t: F.when(q - t * t / n > 1e-13 * q, q - t * t / n).otherwise(0.0)
    xx, yy, xy = spread(sxx, sx), spread(syy, sy), sxy - sx * sy / n
    fine = F.col("_f_odd") - b("odd") == 0
    none_of = lambda k: fine & (F.col(f"_f_{k}") == b(k))
    s = s.withColumns(
        {
            "overlap": F.col("_c.overlap"),
            "maximal_start": F.col("_opening.i"),
            "start_idx": b("i"),
            "end_idx": F.col("_idx"),
            "n_beats": n.cast("int"),
            "sbp_start": b("sbp"),
            "sbp_end": F.col("sbp"),
            "rri_start": b("rri"),
            "rri_end": F.col("rri"),
            "r": F.when(fine, ratio(xy, F.sqrt(xx) * F.sqrt(yy))),
            "slope": F.when(fine, ratio(xy, xx)),
            "concordant": none_of("slow"),
            **{f"gate_{i}": none_of(f"g{i}") for i in range(len(gates))},
        }
    )
    return s.select(*cell, *_MEASURED, *[f"gate_{i}" for i in range(len(gates))])


def _measured(beats: DataFrame, settings: tuple[Setting, ...], cell: list[str], tasks: int) -> DataFrame:
    return (swept if any(s.overlap for s in settings) else whole)(beats, settings, cell, tasks)


def sequences(beats: DataFrame, settings: tuple[Setting, ...], cell: list[str] = CELL, tasks: int = 0) -> DataFrame:
    """Every candidate of every setting with its regression, gates and verdict.

    Settings without overlap look at maximal ramps only; those with overlap at their parts too.
    """
    frame = settings_frame(beats.sparkSession, settings)
    rows = _measured(beats, settings, cell, tasks).join(F.broadcast(frame), [*SCAN, "overlap"])
    rows = rows.where(F.col("direction").isNotNull() & (F.col("n_beats") >= F.col("least_beats")))
    number = F.row_number().over(Window.partitionBy(*cell, "setting", "direction").orderBy("start_idx", "end_idx"))
    steps_of = _gates(settings)
    gate = F.coalesce(*[F.when(F.coalesce("least_rri_step", F.lit(0.0)) == x, F.col(f"gate_{i}")) for i, x in enumerate(steps_of)])
    rows = rows.select(
        *cell,
        "setting",
        "ordinal",
        "direction",
        number.alias("ramp_index"),
        *[F.col(c) for c in ("maximal_start", "start_idx", "end_idx", "n_beats", "sbp_start", "sbp_end", "rri_start", "rri_end", "r", "slope")],
        F.col("gate_0").alias("rri_monotone"),
        F.col("concordant").alias("rri_concordant_1ms"),
        gate.alias("rri_gate"),
        # One candidate of each maximal ramp: the ramp itself, or its first part.
        ((F.col("start_idx") == F.col("maximal_start")) & (~F.col("overlap") | (F.col("n_beats") == F.col("least_beats")))).alias("is_first"),
        *[F.col(c) for c in ("lag", "least_r", "least_r2", "positive_slope", "rri_direction", "use_median")],
    )
    passes = (
        F.col("slope").isNotNull()
        & (~F.col("positive_slope") | (F.col("slope") > 0))
        & (F.col("least_r").isNull() | F.coalesce(F.col("r") >= F.col("least_r"), F.lit(False)))
        & (F.col("least_r2").isNull() | F.coalesce(F.col("r") * F.col("r") > F.col("least_r2"), F.lit(False)))
        & (~F.col("rri_direction") | F.col("rri_gate"))
    )
    return rows.withColumn("qualifies", F.coalesce(passes, F.lit(False)))


def held(found: DataFrame, beats: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """``sequences`` with the beats they are made of: sbp_values, rri_values and the times of both, as arrays in order.

    A cell's beats are packed in blocks of ``BLOCK``, and a sequence meets only the blocks that it is in, mostly one; what each has of
    it comes together by the sequence's number.
    """
    at = F.row_number().over(Window.partitionBy(*cell).orderBy("beat_idx")) - 1
    packed = beats.select(*cell, at.alias("_at"), "t", "sbp", "rri").groupBy(*cell, F.floor(F.col("_at") / BLOCK).alias("_block"))
    packed = packed.agg(F.sort_array(F.collect_list(F.struct("_at", "t", "sbp", "rri"))).alias("_b"))
    number = [*cell, "setting", "direction", "ramp_index"]
    others = [c for c in found.columns if c not in number]
    last = F.col("start_idx") + F.col("n_beats") - 1 + F.col("lag")
    rows = found.withColumns({"_last": last, "_block": F.explode(F.sequence(F.floor(F.col("start_idx") / BLOCK), F.floor(last / BLOCK)))}).join(packed, [*cell, "_block"])
    first = F.col("_block") * BLOCK
    begin, end = F.greatest(F.col("start_idx"), first), F.least(F.col("_last"), first + BLOCK - 1)
    part = F.slice("_b", (begin - first + 1).cast("int"), (end - begin + 1).cast("int"))
    rows = rows.groupBy(*number).agg(F.first(F.struct(*others)).alias("_row"), F.sort_array(F.collect_list(F.struct("_block", part.alias("_b")))).alias("_parts"))
    rows = rows.select(*number, "_row.*", F.flatten(F.transform("_parts", lambda p: p["_b"])).alias("_b"))
    parts = {"_s": F.slice("_b", F.lit(1), F.col("n_beats")), "_r": F.slice("_b", F.col("lag") + 1, F.col("n_beats"))}
    get = lambda c, k: F.transform(c, lambda b: b[k])
    rows = rows.withColumns(parts).withColumns({"sbp_values": get("_s", "sbp"), "rri_values": get("_r", "rri"), "sbp_times": get("_s", "t"), "rri_times": get("_r", "t")})
    return rows.select(*found.columns, "sbp_values", "rri_values", "sbp_times", "rri_times")


def provenance(beats: DataFrame, settings: tuple[Setting, ...], cell: list[str] = CELL, tasks: int = 0) -> DataFrame:
    """A row for every candidate with all that its verdict rests on: its beats as text, the regression, and each gate for itself."""
    rows = held(sequences(beats, settings, cell, tasks), beats, cell)
    first, last = (lambda c: F.col(c)[0]), (lambda c: F.element_at(c, -1))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.col("n_beats")
    rows = rows.withColumns(
        {
            "sbp_start_beat": F.col("start_idx") + 1,
            "sbp_end_beat": F.col("end_idx") + 1,
            "rri_start_beat": F.col("start_idx") + F.col("lag") + 1,
            "rri_end_beat": F.col("end_idx") + F.col("lag") + 1,
            **{f"{s}_{e}_t": f(f"{s}_times") for s in ("sbp", "rri") for e, f in (("start", first), ("end", last))},
            "sbp_amplitude": F.col("sbp_end") - F.col("sbp_start"),
            "sbp_amplitude_abs": F.abs(F.col("sbp_end") - F.col("sbp_start")),
            "rri_response": F.col("rri_end") - F.col("rri_start"),
            "rri_response_abs": F.abs(F.col("rri_end") - F.col("rri_start")),
            "intercept": mean("rri_values") - F.col("slope") * mean("sbp_values"),
            "r_squared": F.col("r") * F.col("r"),
            "rri_threshold_gate": F.col("rri_gate"),
            "correlation_gate": F.col("least_r").isNull() | F.coalesce(F.col("r") >= F.col("least_r"), F.lit(False)),
            "r2_gate": F.col("least_r2").isNull() | F.coalesce(F.col("r") * F.col("r") > F.col("least_r2"), F.lit(False)),
            "slope_gate": F.col("slope").isNotNull() & (~F.col("positive_slope") | (F.col("slope") > 0)),
            **{f"{c}_text": text_array(F.col(c)) for c in ("sbp_values", "rri_values", "sbp_times", "rri_times")},
        }
    )
    return rows.drop("sbp_values", "rri_values", "sbp_times", "rri_times", "ordinal", "least_r", "least_r2", "positive_slope", "rri_direction", "use_median", "rri_gate", "start_idx", "end_idx", "maximal_start")


def _levels(settings: tuple[Setting, ...], field: str) -> list:
    return sorted({getattr(s, field) for s in settings} - {None})


def rollup(found: DataFrame, settings: tuple[Setting, ...], cell: list[str] = CELL) -> DataFrame:
    """Counts, BEI and gain per (cell, setting) and direction up, down, all, of measured ramps with markers.

    Ramps are first added up by what settings ask of them: how many of the limits of beats, r and r2 they reach, and gates. Settings
    then choose among these sums, so that no ramp is copied for every setting. ``all`` pools the slopes of both directions.
    reason tells why a gain is null. Medians, which hold their slopes, are computed only where some setting wants them.
    """
    beats_of, r_of, r2_of, gates = _levels(settings, "least_beats"), _levels(settings, "least_r"), _levels(settings, "least_r2"), _gates(settings)
    reached = lambda passes: sum((F.coalesce(c, F.lit(False)).cast("int") for c in passes), F.lit(0))
    medians = [*{(s.lag, float(s.least_step), s.strict_step, s.overlap) for s in settings if s.median}]
    wants = F.lit(False)
    for lag, least, strict, overlap in medians:
        wants = wants | ((F.col("lag") == lag) & (F.col("least_step") == least) & (F.col("strict_step") == strict) & (F.col("overlap") == overlap))
    r, slope, n_beats = F.col("r"), F.col("slope"), F.col("n_beats")
    kinds = {
        "_beats": reached(n_beats >= x for x in beats_of),
        "_exact": n_beats.isin(beats_of),
        "_opens": F.col("start_idx") == F.col("maximal_start"),
        "_r": reached(r >= x for x in r_of),
        "_r2": reached(r * r > x for x in r2_of),
        "_known": slope.isNotNull(),
        "_rising": F.coalesce(slope > 0, F.lit(False)),
        **{f"gate_{i}": F.col(f"gate_{i}") for i in range(len(gates))},
    }
    sums = {
        "_slope": slope, "_n_beats": n_beats, "_sum_r": r, "_sum_r2": r * r,
        "_sbp": F.abs(F.col("sbp_end") - F.col("sbp_start")), "_rri": F.abs(F.col("rri_end") - F.col("rri_start")),
    }
    held = [F.collect_list(F.when(wants, slope)).alias("_slopes")] if medians else []
    marker = F.col("direction").isNull()
    rows = found.where(marker | (n_beats >= beats_of[0]))
    by = rows.groupBy(*cell, *SCAN, "overlap", "direction", *[c.alias(k) for k, c in kinds.items()])
    by = by.agg(F.count("direction").alias("_n"), F.count("r").alias("_n_r"), *[F.sum(c).alias(k) for k, c in sums.items()], *held)

    limits = lambda c, of: F.coalesce(*[F.when(F.col(c) == x, i + 1) for i, x in enumerate(of)], F.lit(0)) if of else F.lit(0)
    frame = settings_frame(found.sparkSession, settings)
    frame = frame.select("setting", *SCAN, "overlap", "positive_slope", "rri_direction", "use_median", limits("least_beats", beats_of).alias("_at_beats"), limits("least_r", r_of).alias("_at_r"), limits("least_r2", r2_of).alias("_at_r2"), F.coalesce("least_rri_step", F.lit(0.0)).alias("_at_gate"))
    both = by.join(F.broadcast(frame), [*SCAN, "overlap"]).where(marker | (F.col("_beats") >= F.col("_at_beats")))
    gate = F.coalesce(*[F.when(F.col("_at_gate") == x, F.col(f"gate_{i}")) for i, x in enumerate(gates)])
    passes = F.col("_known") & (~F.col("positive_slope") | F.col("_rising")) & (F.col("_r") >= F.col("_at_r")) & (F.col("_r2") >= F.col("_at_r2")) & (~F.col("rri_direction") | gate)
    ways = F.when(marker, F.array(*map(F.lit, ("up", "down", "all")))).otherwise(F.array("direction", F.lit("all")))
    both = both.withColumns({"_q": F.coalesce(passes & ~marker, F.lit(False)), "_gate": gate, "_way": ways}).withColumn("direction", F.explode("_way"))
    # One candidate of each maximal ramp: the ramp itself, or its first part.
    first = F.col("_opens") & (~F.col("overlap") | (F.col("_exact") & (F.col("_beats") == F.col("_at_beats"))))
    kept = lambda c: F.sum(F.when(F.col("_q"), F.col(c)))
    some = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    values = F.flatten(F.collect_list(F.when(F.col("_q") & F.col("use_median"), F.col("_slopes")))) if medians else F.max(F.lit(None).cast("array<double>"))
    out = both.groupBy(*cell, "setting", "direction").agg(
        F.sum("_n").alias("n_ramps"),
        some("_n", F.col("_q")).alias("n_sequences"),
        some("_n", first).alias("n_maximal"),
        some("_n", F.col("_gate")).alias("n_rri_gate"),
        some("_n_r", F.col("_q")).alias("_n_r"),
        *[kept(c).alias(c) for c in sums],
        F.sort_array(values).alias("_values"),
        F.first("rri_direction").alias("rri_direction"),
        F.first("use_median").alias("use_median"),
    )
    n, m = F.col("n_ramps"), F.col("n_sequences")
    low, high = (F.get("_values", F.floor((m - i) / 2).cast("int")) for i in (1, 0))
    gain = F.when(~F.col("use_median"), ratio(F.col("_slope"), m)).when(m > 0, 0.5 * low + 0.5 * high)
    reason = (
        F.when(n == 0, "NO_CANDIDATE_SBP_RAMP")
        .when(m > 0, "NA")
        .when(~F.col("rri_direction"), "NO_CANDIDATE_PASSED_CORRELATION")
        .when(F.col("n_rri_gate") == 0, "NO_RRI_THRESHOLD_CONCORDANT_CANDIDATE")
        .otherwise("NO_CANDIDATE_PASSED_R2_AND_SLOPE")
    )
    return out.select(
        *cell,
        "setting",
        "direction",
        "n_ramps",
        "n_maximal",
        "n_sequences",
        ratio(m, n).alias("bei"),
        gain.alias("gain"),
        ratio(F.col("_n_beats"), m).alias("mean_beats"),
        ratio(F.col("_sum_r"), F.col("_n_r")).alias("mean_r"),
        ratio(F.col("_sum_r2"), F.col("_n_r")).alias("mean_r2"),
        ratio(F.col("_sbp"), m).alias("mean_sbp_amplitude"),
        ratio(F.col("_rri"), m).alias("mean_rri_response"),
        reason.alias("reason"),
    )


def gains(beats: DataFrame, settings: tuple[Setting, ...], cell: list[str] = CELL, tasks: int = 0) -> DataFrame:
    """The gain table of every setting over all cells of ``beats``; see ``steps`` for ``tasks``."""
    return rollup(_measured(beats, settings, cell, tasks), settings, cell)
