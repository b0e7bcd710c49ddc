"""Ramps, sequences and gains on hand-computed series."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest

from rampflow.operators import ramps
from rampflow.schema import BRANCHES, CANONICAL, FACTORIAL, OFAT

LAG0 = replace(CANONICAL, name="lag0", lag=0)
A0 = BRANCHES[1]
UP, DOWN = [100.0, 102, 104, 90], [104.0, 102, 100, 110]


def beats(spark, sbp, rri, subject="1", phase="Pre"):
    rows = [(subject, phase, i + 1, float(i), float(r), float(s)) for i, (s, r) in enumerate(zip(sbp, rri, strict=True))]
    return spark.createDataFrame(rows, "subject string, phase string, beat_idx int, t double, rri double, sbp double")


def run(spark, sbp, rri, *settings):
    return [r.asDict() for r in ramps.sequences(beats(spark, sbp, rri), settings).orderBy("direction", "ramp_index").collect()]


CASES = [
    ("rising", UP, [700, 710, 720, 700], LAG0, [("up", 0, 2, True, True)]),
    ("falling", DOWN, [720, 710, 700, 730], LAG0, [("down", 0, 2, True, True)]),
    ("not monotone, still correlated", UP, [700, 712, 711, 700], LAG0, [("up", 0, 2, True, False)]),
    ("not monotone, gated", UP, [700, 712, 711, 700], replace(LAG0, rri_direction=True), [("up", 0, 2, False, False)]),
    ("weakly correlated", [100.0, 102, 104, 106, 90], [700, 700.001, 700.002, 800, 700], replace(LAG0, least_beats=4), [("up", 0, 3, False, True)]),
    ("too short", UP, [700, 710, 720, 700], replace(LAG0, least_beats=4), []),
    ("two ramps share no beat", [100.0, 102, 104, 100, 102, 104, 90], [700, 710, 720, 700, 710, 720, 700], LAG0, [("up", 0, 2, True, True), ("up", 3, 5, True, True)]),
    ("step equal to the threshold, inclusive", [100.0, 101, 102], [700, 710, 720], LAG0, [("up", 0, 2, True, True)]),
    ("step equal to the threshold, strict", [100.0, 101, 102], [700, 710, 720], A0, []),
    ("step above the threshold, strict", [100.0, 101.0001, 102.0002], [700, 710, 720], A0, [("up", 0, 2, True, True)]),
    ("shortest aligned series", UP, [600, 700, 710, 720], CANONICAL, [("up", 0, 2, True, True)]),
    ("turning beat in both ramps", [100.0, 102, 104, 102, 100], [700, 710, 720, 710, 700], LAG0, [("down", 2, 4, True, True), ("up", 0, 2, True, True)]),
]


@pytest.mark.parametrize(("name", "sbp", "rri", "setting", "want"), CASES, ids=[c[0] for c in CASES])
def test_cases(spark, name, sbp, rri, setting, want):
    got = run(spark, sbp, rri, setting)
    assert [(r["direction"], r["start_idx"], r["end_idx"], r["qualifies"], r["rri_monotone"]) for r in got] == want


def test_non_finite_values(spark):
    got = run(spark, UP, [700, float("inf"), 720, 700], LAG0)
    assert [(r["slope"], r["r"], r["qualifies"]) for r in got] == [(None, None, False)]
    assert run(spark, [100.0, float("nan"), 104, 106, 90], [700, 710, 720, 730, 700], LAG0) == []


def test_constant_intervals_do_not_divide_by_zero(spark):
    assert [(r["r"], r["qualifies"]) for r in run(spark, UP, [700, 700, 700, 700], LAG0)] == [(None, False)]


def test_small_interval_steps(spark):
    r = run(spark, UP, [700, 700.2, 700.4, 699], LAG0)[0]
    assert r["qualifies"] and r["rri_monotone"] and not r["rri_concordant_1ms"]


def test_lags_shift_intervals(spark):
    settings = [replace(CANONICAL, name=str(k), lag=k) for k in (0, 1, 2)]
    got = run(spark, [100.0, 102, 104, 90, 90, 90], [500, 600, 700, 710, 720, 500], *settings)
    assert {r["setting"]: r["rri_start"] for r in got if r["direction"] == "up"} == {"0": 500, "1": 600, "2": 700}


def test_slope_units(spark):
    assert run(spark, [100.0, 102, 104], [800, 810, 820], A0)[0]["slope"] == pytest.approx(5.0)


def test_r2_boundary_is_strict(spark):
    sbp, rri = [98.0, 100, 102], [700.0, 705, 720]
    r = run(spark, sbp, rri, A0)[0]
    at = r["r"] ** 2
    assert not run(spark, sbp, rri, replace(A0, least_r2=at))[0]["qualifies"]
    assert run(spark, sbp, rri, replace(A0, least_r2=at - 1e-10))[0]["qualifies"]


@pytest.mark.parametrize("n", [3, 4, 5, 7])
def test_overlap_counts(spark, n):
    sbp, rri = [100.0 + 2 * i for i in range(n)], [700 + 10 * i for i in range(n)]
    got = run(spark, sbp, rri, BRANCHES[3])
    assert len(got) == (n - 2) * (n - 1) // 2
    assert len({(r["start_idx"], r["end_idx"]) for r in got}) == len(got)


def gains(spark, sbp, rri, *settings):
    return {(r["setting"], r["direction"]): r for r in ramps.gains(beats(spark, sbp, rri), settings).collect()}


def test_gain_pools_directions_and_counts(spark):
    sbp, rri = [100.0, 102, 104, 102, 100, 98, 100, 102, 104], [700, 710, 720, 705, 690, 675, 700, 710, 720]
    g = gains(spark, sbp, rri, LAG0, replace(LAG0, name="median", median=True))
    up, down, both = (g["lag0", d] for d in ("up", "down", "all"))
    assert both["n_ramps"] == up["n_ramps"] + down["n_ramps"] == 3
    assert both["gain"] == pytest.approx((up["gain"] * up["n_sequences"] + down["gain"] * down["n_sequences"]) / both["n_sequences"])
    assert both["bei"] == pytest.approx(both["n_sequences"] / 3)
    assert g["median", "all"]["gain"] is not None


def test_reasons(spark):
    g = gains(spark, [100.0, 100.4, 100.8], [700, 710, 720], A0)
    assert g["A0_MAX", "all"]["gain"] is None and g["A0_MAX", "all"]["reason"] == "NO_CANDIDATE_SBP_RAMP"
    assert gains(spark, UP, [720, 710, 700, 700], LAG0)["lag0", "all"]["reason"] == "NO_CANDIDATE_PASSED_CORRELATION"
    assert gains(spark, UP, [700, 700.5, 701, 700], A0)["A0_MAX", "all"]["reason"] == "NO_RRI_THRESHOLD_CONCORDANT_CANDIDATE"
    assert gains(spark, UP, [700, 702, 730, 700], A0)["A0_MAX", "up"]["reason"] == "NO_CANDIDATE_PASSED_R2_AND_SLOPE"


def test_settings():
    assert CANONICAL.setting_id == "lag1_r0p80_sbp1p0_len3_mean"
    assert replace(CANONICAL, rri_direction=True).setting_id.endswith("_directional_rri_gate")
    assert len(OFAT) == 8 and len({s.name for s in FACTORIAL}) == 72


def test_result_does_not_depend_on_partitions(spark):
    b = beats(spark, UP * 40, [700, 710, 720, 705] * 40).union(beats(spark, DOWN * 40, [720, 700, 690, 730] * 40, "2", "Stim"))
    a, c = (sorted(map(str, ramps.gains(d, BRANCHES).collect())) for d in (b.repartition(1), b.repartition(8)))
    assert a == c


@pytest.mark.parametrize("settings", [OFAT, BRANCHES], ids=["maximal", "parts"])
def test_one_exchange_and_one_read(spark, settings):
    """From beats to gains rows move once, by cell, and are read once; no join but with the settings."""
    b = beats(spark, UP, [700, 710, 720, 700])
    plan = ramps.gains(b, settings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(subject") == 1 == plan.count("Exchange hashpartitioning") and "SortMergeJoin" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_parts_by_definition(spark, seed):
    """Every part of every ramp by its own beats, with level, infinite and missing intervals among them."""
    import random

    import numpy as np

    r = random.Random(seed)
    sbp = [100.0]
    for _ in range(150):
        sbp.append(sbp[-1] + r.choice([2.5, 2.5, 2.5, 1.0, -2.5]))
    rri = [float(r.choice([700.1, 700.1, 710.3, 720.7, 731.9])) for _ in sbp]
    rri[40], rri[90] = float("inf"), float("nan")
    setting = BRANCHES[3]
    got = {(x["direction"], x["start_idx"], x["end_idx"]): x for x in ramps.sequences(beats(spark, sbp, rri), (setting, A0)).where("setting = 'A0_OVERLAP'").collect()}
    want, start = {}, 0
    x, y = np.array(sbp), np.array(rri)
    while start < len(x) - 1:
        d = np.sign(x[start + 1] - x[start]) if abs(x[start + 1] - x[start]) > 1 else 0
        end = start
        while end + 1 < len(x) and d and np.sign(x[end + 1] - x[end]) == d and abs(x[end + 1] - x[end]) > 1:
            end += 1
        for s in range(start, end - 1):
            for e in range(s + 2, end + 1):
                want["up" if d > 0 else "down", s, e] = (x[s : e + 1], y[s : e + 1], d, s == start and e == s + 2)
        start = max(end, start + 1)
    assert set(got) == set(want)
    for key, (a, b, d, first) in want.items():
        row = got[key]
        fine = np.isfinite(b).all()
        moves = d * np.diff(b)
        assert row["n_beats"] == len(a) and row["is_first"] == first and (row["sbp_start"], row["sbp_end"]) == (a[0], a[-1])
        assert (row["rri_monotone"], row["rri_concordant_1ms"]) == (bool(fine and (moves > 0).all()), bool(fine and (moves >= 1).all()))
        assert row["slope"] == (pytest.approx(np.polyfit(a, b, 1)[0], abs=1e-9) if fine else None)
        assert row["r"] == (pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9) if fine and np.ptp(b) > 0 else None)


def test_cells_without_ramps_have_rows(spark):
    """Also cells of fewer beats than the lag."""
    b = beats(spark, [100.0], [700]).union(beats(spark, [100.0, 100.2, 100.1], [700, 701, 702], "2")).union(beats(spark, UP, [700, 710, 720, 700], "3"))
    for settings in (OFAT, BRANCHES):
        got = ramps.gains(b, settings).collect()
        assert len(got) == 3 * 3 * len(settings) and {r["reason"] for r in got if r["subject"] in "12"} == {"NO_CANDIDATE_SBP_RAMP"}
        assert {(r["n_ramps"], r["n_maximal"], r["n_sequences"], r["bei"]) for r in got if r["subject"] in "12"} == {(0, 0, 0, None)}
        assert ramps.sequences(b, settings).where("direction is null").count() == 0


def test_beats_of_sequences_come_from_blocks(spark, monkeypatch):
    """Sequences in one block and over several, with the lag's beats in a later one, hold their own beats; no row holds a whole cell."""
    monkeypatch.setattr(ramps, "BLOCK", 3)
    rng = random.Random(5)
    sbp, level = [], 100.0
    for _ in range(80):
        level += rng.choice((1.5, 1.5, 1.5, -1.5, -1.5))
        sbp.append(level)
    rri = [700 + 3 * s + rng.random() for s in sbp]
    b = beats(spark, sbp, rri).unionByName(beats(spark, sbp[::-1], rri, subject="2"))
    found = ramps.sequences(b, (replace(CANONICAL, name="lag2", lag=2), replace(BRANCHES[3], name="parts")))
    rows = ramps.held(found, b).collect()
    assert len(rows) == found.count() > 40 and max(r["n_beats"] for r in rows) > 4
    for r in rows:
        own = slice(r["start_idx"], r["start_idx"] + r["n_beats"])
        later = slice(own.start + r["lag"], own.stop + r["lag"])
        assert r["sbp_values"] == (sbp if r["subject"] == "1" else sbp[::-1])[own] and r["rri_values"] == rri[later]
        assert r["sbp_times"] == [float(i) for i in range(own.start, own.stop)] and r["rri_times"] == [float(i) for i in range(later.start, later.stop)]


def _rows(df):
    return sorted(str([round(v, 9) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.collect())


@pytest.mark.parametrize("settings", [OFAT, BRANCHES, FACTORIAL[:1] + FACTORIAL[-1:]], ids=["maximal", "parts", "medians"])
def test_blocks_of_a_cell_equal_the_whole_cell(spark, monkeypatch, settings):
    """Ramps that begin and end in any block, some longer than two blocks, with odd intervals; cells shorter than a block and than the lag."""
    monkeypatch.setattr(ramps, "SPAN", 4)
    rng = random.Random(7)
    sbp = [100.0]
    for _ in range(120):
        sbp.extend(sbp[-1] + (i + 1) * rng.choice((-1.5, 1.5, 0.7)) for i in range(rng.choice((1, 2, 3, 11))))
    rri = [700 + 2 * s + rng.random() for s in sbp]
    rri[40], rri[90] = float("inf"), float("nan")
    b = beats(spark, sbp, rri).unionByName(beats(spark, sbp[:7], rri[:7], "2")).unionByName(beats(spark, [100.0], [700], "3"))
    want = _rows(ramps.gains(b, settings))
    assert len(want) == 3 * 3 * len(settings) and _rows(ramps.gains(b, settings, tasks=3)) == want
    assert _rows(ramps.sequences(b, settings, tasks=3)) == _rows(ramps.sequences(b, settings))


def test_blocks_are_dealt_over_tasks(spark):
    """A cell is not one task's: beats move by cell and block."""
    plan = ramps.gains(beats(spark, UP, [700, 710, 720, 700]), OFAT, tasks=7)._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan.split("REPARTITION_BY_NUM")[0].rsplit("Exchange hashpartitioning", 1)[1]


def test_ramps_are_added_up_before_settings_choose(spark):
    """A setting is no copy of the ramps: 60 settings of one step rule join sums, which are as few as there are outcomes."""
    b = beats(spark, UP * 300, [700, 712, 711, 705] * 300)
    settings = tuple(replace(LAG0, name=str(i), least_r=i / 100) for i in range(60))
    got = ramps.gains(b, settings)
    assert len(got.collect()) == 180
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("BroadcastHashJoin", 1)[1].split("Exchange hashpartitioning", 1)[0] and {r["n_ramps"] for r in got.where("direction = 'up'").collect()} == {300}
