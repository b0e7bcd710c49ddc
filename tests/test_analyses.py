"""Whole analyses on made-up cohorts, reports, waves and validated joins."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampflow.operators import decisions, joins, linear, waves
from rampflow.operators.kernels import nonlinear, regression
from rampflow.plans import analyses
from rampflow.sources import reports

BEATS = "subject string, phase string, beat_idx int, t double, rri double, sbp double"


@pytest.fixture(scope="module")
def cohort(spark):
    """Six subjects, three phases: intervals follow pressure one beat later, with less gain in Stim."""
    rng, rows = np.random.default_rng(11), []
    for s in range(6):
        for phase, gain in (("Pre", 8.0), ("Stim", 4.0), ("Post", 7.0)):
            sbp = 120 + np.cumsum(rng.normal(0, 2.0, 320)) * 0.3 + rng.normal(0, 2, 320)
            rri = 850 + gain * (np.concatenate(([sbp[0]], sbp[:-1])) - 120) + rng.normal(0, 3, 320)
            t = np.cumsum(rri) / 1000
            rows += [(f"S{s:02d}", phase, i + 1, float(t[i]), float(rri[i]), float(sbp[i])) for i in range(320)]
    return spark.createDataFrame(rows, BEATS).cache()


def test_sequence_analysis(spark, cohort):
    out = analyses.sequence_analysis(cohort, times=300)
    c = {r["contrast"]: r for r in out["contrasts"].collect()}
    assert c["Stim-Pre"]["mean_difference"] < -2 and c["Stim-Pre"]["n"] == 6 and c["Stim-Pre"]["n_negative"] == 6
    assert c["Stim-Pre"]["p"] == pytest.approx(2 / 2**6) and c["Stim-Pre"]["q"] == c["Stim-Pre"]["p"] and c["Post-Pre"]["q"] is None
    assert c["Stim-Pre"]["low"] < c["Stim-Pre"]["mean_difference"] < c["Stim-Pre"]["high"] and c["Stim-Pre"]["status"] == "LOW_ESTIMABILITY"
    assert out["factorial"].where("contrast = 'Stim-Pre'").count() == 72
    assert out["one_factor"].count() == 24 and out["leave_one_out"].count() == 18
    assert out["factorial_agreement"].where("contrast = 'Stim-Pre' and setting like 'lag1%' and not agrees").count() == 0
    assert out["eligible"].where("eligible").count() == 6


def test_gate_stops_an_analysis(spark, cohort):
    anchors = spark.createDataFrame([("canonical", "Stim-Pre", 1.0)], "setting string, contrast string, mean_difference double")
    with pytest.raises(AssertionError, match="anchors"):
        analyses.sequence_analysis(cohort, anchors)
    with pytest.raises(AssertionError, match="dense_index"):
        analyses.branch_analysis(cohort.where("beat_idx <> 5"))


def test_branch_analysis(cohort):
    out = analyses.branch_analysis(cohort)
    assert out["contrasts"].count() == 15 and out["agreement"].count() == 4
    assert out["gains"].count() == 6 * 3 * 5 * 3
    assert out["rank_tests"].where("p is null").count() == 0


def test_autoregression_analysis(cohort):
    out = analyses.autoregression_analysis(cohort)
    tests = out["tests"].collect()
    assert len(tests) == 36 and all(r["p"] < 0.01 for r in tests if r["direction"] == "sbp_to_rri")
    assert all(r["share"] == 1.0 for r in out["prevalence"].where("direction = 'sbp_to_rri'").collect())
    q = {r["direction"]: r["status"] for r in out["cochran"].collect()}
    assert q["sbp_to_rri"] == "not_estimable"


def test_coherence_and_coupling(cohort):
    some = cohort.where("subject in ('S00', 'S01')")
    cells = analyses.coherence_analysis(some, 19)["cells"].collect()
    assert len(cells) == 6 and all(0 <= r["observed"] <= 1 and 0.05 <= r["p"] <= 1 for r in cells)
    out = analyses.coupling_analysis(some.withColumn("t", F.lit(None).cast("double")), ("SSC",), 160, shifts=9, times=100)
    got = out["cells"].collect()
    assert len(got) == 12 and all(r["reason"] == "NA" and 0.1 <= r["p"] <= 1 for r in got)
    assert out["missing"].agg(F.sum("missing")).first()[0] == 0


def test_coherence_validation(spark):
    got = {r["scenario"]: r for r in analyses.coherence_validation(spark, 24, 39).collect()}
    assert got["uncoupled"]["passed"] and got["shared"]["share"] >= 0.7
    with pytest.raises(ValueError, match="half the rate"):
        analyses.coherence_sensitivity(spark.createDataFrame([], BEATS), 4.0, (1.0, 3.0))


def test_sensitivities(cohort):
    some = cohort.where("subject in ('S00', 'S01', 'S02')")
    out = analyses.coherence_sensitivity(some)
    assert out["cells"].count() == 18 and out["checks"].count() == 6
    known = out["cells"].where("size = 512")
    for reference, passed in ((known, True), (known.withColumn("coherence", F.col("coherence") + 1e-6), False), (known.where("subject <> 'S00'"), False)):
        checks = {r["name"]: r["passed"] for r in analyses.coherence_sensitivity(some, reference=reference)["checks"].collect()}
        assert len(checks) == 7 and checks["reference_reproduced"] == passed and checks["only_segment_length_differs"]
    from rampflow.schema import NEIGHBOURS

    chosen = tuple(s for s in NEIGHBOURS if s.name in ("primary", "lag4", "same_beat_convention"))
    effects = analyses.coupling_sensitivity(some, chosen, ("LP",))["effects"].collect()
    assert len(effects) == 6 and all(r["agrees"] for r in effects if r["setting"] == "primary" and r["mean_difference"])


def test_subphases(cohort):
    out = analyses.subphase_analysis(cohort.where("subject = 'S00' and phase = 'Pre'"))
    assert {r["phase"] for r in out["gains"].select("phase").distinct().collect()} <= {"Pre_early", "Pre_late"}
    assert {(r["outcome"], r["contrast"]) for r in out["contrasts"].collect()} >= {("gain_REF_all", "Pre_late-Pre_early"), ("n_beats", "Pre_late-Pre_early")}
    assert out["outcomes"].select("outcome").distinct().count() == 44
    assert out["pattern"].first()["class"] == "NONESTIMABLE_DUE_TO_SEQUENCE_SCARCITY"


def test_anchors(spark):
    from rampflow.operators import audit

    known = spark.createDataFrame([("a", 1.0, 0.1), ("b", 1.0, 0.1), ("c", 1.0, 0.1)], "name string, value double, tolerance double")
    values = spark.createDataFrame([("a", 1.05), ("b", 1.5)], "name string, value double")
    assert {r["name"]: r["passed"] for r in audit.anchors(values, known).collect()} == {"a": True, "b": False, "c": False}


def test_joins(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([("x", 10), ("y", 20)], "k string, w int")
    assert joins.many_to_one(a, b, ["k"]).count() == 3
    for f in (lambda: joins.many_to_one(b, a, ["k"]), lambda: joins.one_to_one(a, b, ["k"])):
        with pytest.raises(Exception, match="occurs twice"):
            f().collect()
    assert {(r["direction"], r["target"], r["source"]) for r in joins.directions(b.withColumn("z", F.lit(0)), "w", "z").where("k = 'x'").collect()} == {("w_to_z", 0, 10), ("z_to_w", 10, 0)}
    assert joins.strict_cast(spark.createDataFrame([("1.5",), (None,)], "x string"), {"x": "double"}).agg(F.sum("x")).first()[0] == 1.5
    with pytest.raises(Exception, match="not double"):
        joins.strict_cast(spark.createDataFrame([("q",)], "x string"), {"x": "double"}).collect()
    grid = joins.dense_grid(b, spark.createDataFrame([("x",), ("z",)], "k string"))
    assert {r["k"]: r["w"] for r in grid.collect()} == {"x": 10, "z": None}


def validation_rows(spark, right=0.9, false=0.05, failed=0):
    rows = []
    for method in ("LP", "SSC"):
        for scenario in nonlinear.SCENARIOS:
            for noise in nonlinear.NOISE_NAMES:
                for i in range(20):
                    good = i < 20 * right
                    rows.append((method, scenario, noise, i, None if i < failed else (1.0 if good else 0.0), 0.5, i < 20 * false, i < 20 * false))
    return spark.createDataFrame(rows, "method string, scenario string, noise string, replicate int, forward double, reverse double, forward_hit boolean, reverse_hit boolean")


def test_validation_gate(spark):
    status = lambda **o: {r["status"] for r in decisions.method_gate(decisions.validation_summary(validation_rows(spark, **o))).collect()}
    assert status() == {"VALIDATED"}
    assert status(right=0.75) == status(false=0.15) == status(failed=3) == {"METHOD_NOT_VALIDATED"}
    rows = validation_rows(spark)
    assert decisions.reusable(rows, rows.count(), F.lit("x"), "x").first()["reusable"]
    assert not decisions.reusable(rows, rows.count() + 1, F.lit("x"), "x").first()["reusable"]
    assert not decisions.reusable(rows.union(rows), 2 * rows.count(), F.lit("x"), "x").first()["reusable"]
    assert not decisions.reusable(rows, rows.count(), F.lit("x"), "y").first()["reusable"]


@pytest.mark.parametrize(
    ("change", "verdict"),
    [
        ({}, "SI_BRIEF_NULL_SENSITIVITY"),
        ({"q": 0.01, "p": 0.001, "low": 0.1}, "SI_EXPLORATORY_NON_NULL"),
        ({"q": 0.01, "p": 0.001, "low": 0.1, "agrees": False}, "RESPONSE_ONLY_INCONCLUSIVE"),
        ({"q": 0.01, "p": 0.001, "low": -0.1}, "RESPONSE_ONLY_INCONCLUSIVE"),
        ({"p": 0.03}, "RESPONSE_ONLY_INCONCLUSIVE"),
        ({"dz": 0.8}, "RESPONSE_ONLY_INCONCLUSIVE"),
        ({"mcnemar_p": 0.01}, "RESPONSE_ONLY_INCONCLUSIVE"),
        ({"n": 12}, "DO_NOT_REPORT_REAL_DATA_INFERENCE"),
        ({"status": "METHOD_NOT_VALIDATED"}, "DO_NOT_REPORT_REAL_DATA_INFERENCE"),
    ],
)
def test_adoption(spark, change, verdict):
    o = {"n": 18, "low": -0.2, "high": 0.3, "p": 0.4, "q": 0.6, "dz": 0.1, "status": "VALIDATED", "mcnemar_p": 0.5, "agrees": True} | change
    table = spark.createDataFrame([("LP", "sbp_to_rri", "Stim-Pre", o["n"], o["low"], o["high"], o["p"], o["q"], o["dz"])], "method string, direction string, contrast string, n int, low double, high double, p double, q double, dz double")
    effects = spark.createDataFrame([("LP", "sbp_to_rri", s, 1.0, s == "primary" or o["agrees"]) for s in ("primary", "k20", "k40")], "method string, direction string, setting string, mean_difference double, agrees boolean")
    judged = decisions.outcomes(table, decisions.stability(effects))
    gate = spark.createDataFrame([("LP", o["status"])], "method string, status string")
    assert decisions.adoption(gate, judged, spark.createDataFrame([(o["mcnemar_p"], 0.5)], "mcnemar_p double, cochran_p double")).first()["verdict"] == verdict


def test_classes(spark):
    direction = lambda a, b, ref, n=18: decisions.branch_direction(spark.createDataFrame([("A0_MAX", n, a), ("A1_MAX", 18, b), ("REF", 18, ref)], "branch string, n int, mean_difference double")).first()["class"]
    assert direction(-2.0, -2.0, -2.0) == "DIRECTION_PRESERVED_NEGATIVE"
    assert direction(-0.5, -0.5, -2.0) == "DIRECTION_ATTENUATED_BUT_NEGATIVE"
    assert direction(-0.5, 0.5, -2.0) == "METHOD_BRANCHES_DISCORDANT"
    assert direction(0.5, 0.5, -2.0) == "DIRECTION_REVERSED_POSITIVE"
    assert direction(-2.0, -2.0, -2.0, 9) == "DIRECTION_INCONCLUSIVE_DUE_TO_EVALUABILITY"

    def pattern(early, late, sbp=5.0, hr=-1.0, n=18, odd=None):
        rows = [(d, f"Stim_{w}-Pre_late", n, odd if odd is not None and d == "A1_MAX" else v) for w, v in (("early", early), ("late", late)) for d in ("REF", "A0_MAX", "A1_MAX")]
        rows += [(d, f"Stim_{w}-Pre_late", n, v) for w in ("early", "late") for d, v in (("sbp", sbp), ("hr", hr))]
        return decisions.temporal_pattern(spark.createDataFrame(rows, "dimension string, contrast string, n int, mean_difference double")).first()["class"]

    assert pattern(-2.0, -1.9) == "EARLY_PRESSOR_LOWER_BRS_PERSISTS_LATE"
    assert pattern(-2.0, -0.5) == "EARLY_PRESSOR_LOWER_BRS_ATTENUATES_LATE"
    assert pattern(-2.0, 1.0) == "LATE_SHIFT_TOWARD_HIGHER_BRS_LOWER_HR"
    assert pattern(-2.0, -1.0, sbp=-1.0) == "NO_CLEAR_EARLY_LATE_PATTERN"
    assert pattern(-2.0, -1.0, odd=1.0) == "METHOD_DEPENDENT_TEMPORAL_PATTERN"
    assert pattern(-2.0, -1.0, n=10) == "NONESTIMABLE_DUE_TO_SEQUENCE_SCARCITY"

    def association(ref, a0, a1, worst, slope):
        rho = spark.createDataFrame([("REF", 18, ref), ("A0_MAX", 18, a0), ("A1_MAX", 10, a1)], "method string, n int, rho double")
        return decisions.association_class(rho, spark.createDataFrame([("REF", -0.4), ("REF", worst)], "method string, rho double"), spark.createDataFrame([(slope,)], "b double")).first()["class"]

    assert association(-0.5, -0.2, 0.3, -0.1, -0.1) == "CONSISTENT_EXPLORATORY_ASSOCIATION"  # too few in the second branch to count
    assert association(-0.5, 0.2, -0.3, -0.1, -0.1) == association(-0.5, -0.2, 0.3, 0.1, -0.1) == "SUGGESTIVE_BUT_INFLUENCE_SENSITIVE"
    assert association(0.1, -0.2, 0.3, -0.1, -0.1) == "NO_EVIDENCE_OF_MONOTONIC_ASSOCIATION"
    assert association(None, -0.2, 0.3, -0.1, -0.1) == "INCONCLUSIVE"


def test_linear_model_equals_the_kernel(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=60) * (1 + np.abs(x[:, 0]))
    rows = [("g", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)] + [("h", i, float(-y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(60)] + [("g", 99, None, 1.0, 1.0)]
    fit = linear.fit(spark.createDataFrame(rows, "k string, i int, y double, a double, b double"), ["k"], "y", ["a", "b"])
    want = regression.ols(x, y)
    got = {(r["k"], r["term"]): r for r in linear.coefficients(fit).collect()}
    for i, term in enumerate(("constant", "a", "b")):
        assert [got["g", term][c] for c in ("b", "hc3", "p")] == pytest.approx([want[c][i] for c in ("b", "hc3", "p")], rel=1e-8)
        assert got["h", term]["b"] == pytest.approx(-want["b"][i])
    assert got["g", "a"]["beta"] == pytest.approx(want["beta"][1]) and got["g", "a"]["r2"] == pytest.approx(want["r2"])
    for r in fit.rows.where("k = 'g'").collect():
        i = r["i"]
        assert (r["residual"], r["leverage"], r["cook"], r["dfb_a"]) == pytest.approx((want["e"][i], want["leverage"][i], want["cook"][i], want["dfbetas"][i][1]), rel=1e-8)
    few = linear.fit(spark.createDataFrame([("f", i, float(i), 1.0 * i, 2.0 * i) for i in range(9)] + [("g", 1, 1.0, 2.0, 3.0)], "k string, i int, y double, a double, b double"), ["k"], "y", ["a", "b"])
    assert all(r["b"] is None for r in linear.coefficients(few).collect()) and linear.coefficients(few).count() == 6
    assert all(r["statistic"] is None for r in linear.residual_tests(few, "i").collect())
    tests = {r["test"]: (r["statistic"], r["p"]) for r in linear.residual_tests(fit, "i").where("k = 'g'").collect()}
    assert tests["jarque_bera"] == pytest.approx(regression.jarque_bera(want["e"]))
    assert tests["breusch_pagan"] == pytest.approx(regression.breusch_pagan(want["x"], want["e"]))
    assert tests["durbin_watson"][0] == pytest.approx(regression.durbin_watson(want["e"]))


def test_reports(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<testsuites><testsuite name="s"><testcase classname="c" name="a" time="0.5"/><testcase classname="c" name="b"><failure/></testcase><testcase classname="c" name="d"><skipped/></testcase></testsuite></testsuites>')
    assert [(r["name"], r["outcome"]) for r in reports.read_junit(spark, str(tmp_path / "j.xml")).collect()] == [("a", "passed"), ("b", "failed"), ("d", "skipped")]
    df = spark.createDataFrame([("a|b", 0.123456, None), ("c", float("nan"), 2)], "k string, x double, n int")
    assert reports.as_markdown(df).splitlines()[2:] == ["| a\\|b | 0.1235 | NA |", "| c | NA | 2 |"]
    reports.replace_file(str(tmp_path / "g.json"), reports.as_json(df))
    assert reports.read_json(spark, str(tmp_path / "g.json"))[1] == {"k": "c", "n": 2, "x": None}
    assert json.loads(reports.as_json(df))[0]["x"] == 0.123456


def test_waves(spark, tmp_path):
    t = np.arange(4000) / 100
    ecg = -np.exp(-(((t % 0.8) - 0.4) ** 2) / 0.001)
    wave = spark.createDataFrame([("1", i, float(t[i]), float(ecg[i])) for i in range(4000)], "subject string, i long, t double, ecg double")
    found = waves.find_peaks(wave, "ecg", 0.5, 30, invert=True)
    beats = waves.intervals(found)
    assert found.count() == 50 and beats.agg(F.max(F.abs(F.col("rr") - 0.8))).first()[0] < 1e-9
    assert beats.first()["hr"] == pytest.approx(75)
    assert waves.slice_samples(wave, 10, 19).count() == 10
    p = waves.pressures(found.withColumn("height", F.lit(120.0)), found.withColumn("height", F.lit(80.0))).first()
    assert (p["pp"], p["map"]) == (40.0, pytest.approx(93.3333333))
    series = spark.createDataFrame([("1", float(x), math.sin(x / 20), math.cos(x / 20)) for x in np.arange(0, 900.1, 0.9)], "subject string, t double, hr double, bp double")
    table = waves.uniform_table(series, ["hr", "bp"])
    last = table.orderBy(F.desc("i")).first()
    assert table.count() == 1921 and last["at"] == 900.0 and last["hr_uniform"] == pytest.approx(math.sin(45), abs=1e-4)
    assert table.agg(F.max(F.col("outside").cast("int"))).first()[0] == 0
    for seconds, rows, inside in ((1000, 2134, 2134), (500, 1921, 1067)):  # longer series are whole, what lies beyond shorter ones is marked
        part = spark.createDataFrame([("1", float(x), math.sin(x / 20)) for x in np.arange(0, seconds + 1, 1.0)], "subject string, t double, hr double")
        made = waves.uniform_table(part, ["hr"])
        assert (made.count(), made.where("not outside").count()) == (rows, inside)
        assert made.where("not outside").agg(F.max(F.abs(F.col("hr_uniform") - F.sin(F.col("at") / 20)))).first()[0] < 1e-3
    assert waves.band_correlation(table, "hr_uniform", "bp_uniform", 0.005, 0.05).count() == 1921 - 256 + 1
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "hr.csv").write_text("1.5,800\n2.25,790\n")
    assert [r["t_ms"] for r in waves.read_events(spark, f"{tmp_path}/e").orderBy("t_ms").collect()] == [1500.0, 2250.0]


def test_models_of_predictors_with_large_offsets(spark):
    """A time and an id of many digits are no reason to call a model collinear; the figures are those of small numbers."""
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=40), rng.normal(size=40)
    y = 2 + 0.5 * x - 0.3 * z + rng.normal(scale=0.4, size=40)
    rows = [(g, i, float(y[i]), float(x[i] + a), float(1e-3 * z[i] + b)) for g, a, b in (("near", 0.0, 0.0), ("far", 1.7e9, 4e5)) for i in range(40)]
    model = linear.fit(spark.createDataFrame(rows, "k string, i int, y double, a double, b double"), ["k"], "y", ["a", "b"])
    got = {(r["k"], r["term"]): r for r in linear.coefficients(model).collect()}
    for term in ("a", "b"):
        for c in ("b", "hc3", "p", "beta"):
            assert got["far", term][c] == pytest.approx(got["near", term][c], rel=1e-5)
    design = np.column_stack([np.ones(40), x, 1e-3 * z])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [got["near", t]["b"] for t in ("constant", "a", "b")] == pytest.approx(want)
    infl = {(r["k"], r["i"]): r for r in model.rows.collect()}
    inv = np.linalg.inv(design.T @ design)
    e, h = y - design @ want, np.einsum("ij,jk,ik->i", design, inv, design)
    for i in range(40):
        loo = np.sqrt((e @ e - e[i] ** 2 / (1 - h[i])) / 36)
        assert infl["near", i]["leverage"] == pytest.approx(h[i]) and infl["far", i]["leverage"] == pytest.approx(h[i], rel=1e-5)
        assert infl["near", i]["dfb_constant"] == pytest.approx((inv @ design[i])[0] * e[i] / (1 - h[i]) / loo / np.sqrt(inv[0, 0]))
        assert infl["near", i]["dfb_a"] == pytest.approx((inv @ design[i])[1] * e[i] / (1 - h[i]) / loo / np.sqrt(inv[1, 1]))


def test_seeds_are_spawned_by_place(spark):
    """By subject and then phase, as a master seed spawns them; cells that are missing keep their places."""
    rows = [(s, p, i + 1, float(i), 800.0, 120.0) for s, p in (("01", "Pre"), ("01", "Post"), ("02", "Stim"), ("10", "Pre")) for i in range(2)]
    places = {(r["subject"], r["phase"]): r["place"] for r in analyses.cell_places(spark.createDataFrame(rows, "subject string, phase string, beat_idx int, t double, rri double, sbp double")).collect()}
    assert places == {(s, p): 3 * i + j for i, s in enumerate(("01", "02", "10")) for j, p in enumerate(("Pre", "Stim", "Post"))}
    children = np.random.SeedSequence(20260805).spawn(9)
    assert [analyses.spawned_seed(20260805, i) for i in range(9)] == [int(c.generate_state(1, dtype=np.uint32)[0]) for c in children]
