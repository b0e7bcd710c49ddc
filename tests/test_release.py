"""Checks of a release: each passes on results as known and fails on an error that is planted."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from rampflow.operators import contrasts, release

PHASES = ("Pre", "Stim", "Post")


def frames(spark):
    """Small result tables, as the engine makes them, by the check that reads them."""
    make = spark.createDataFrame
    d = [-2.0, -1.0, -3.0, 0.5]
    effects = [(f"s{i}", w, 11 + i, (i - 2.0 if w != "up" else -1.0 - i), 0.5) for i in range(4) for w in ("all", "up", "down")]
    fits = [(str(i), p, 1 + i, "NA", True, 0.2 if i else 0.01, 0.01 if i < 2 else 0.6) for i in range(3) for p in PHASES]
    tests = [(str(i), p, w, True, w == "rri_to_sbp") for i in range(3) for p in PHASES for w in ("rri_to_sbp", "sbp_to_rri")]
    return {
        "central": (make([(str(i), v) for i, v in enumerate(d)], "subject string, d double"), make([("mean", -3.0, -0.5), ("dz", -1.0, 0.0)], "statistic string, low double, high double"), make([(0.25,)], "p double")),
        "landscape": (make(effects, "setting string, direction string, n int, mean_difference double, p double"),),
        "coherence": (
            make([(512, "Stim-Pre", 0.02, 0.7), (256, "Stim-Pre", 0.03, 0.6), (512, "Post-Pre", 9.0, 0.1)], "size int, contrast string, mean_difference double, p double"),
            make([("Pre", 14), ("Stim", 15), ("Post", 15)], "phase string, successes int"),
            make([("Stim-Pre", 1.0), ("Post-Pre", 0.5)], "contrast string, p double"),
            make([(0.846,)], "p double"),
        ),
        "haemodynamics": (make([("mean_sbp", "Stim-Pre", 6.1, 0.005, 0.04), ("mean_hr", "Stim-Pre", 1.0, 0.5, 0.6), ("mean_sbp", "Post-Pre", 2.0, 0.5, 0.6)], "metric string, contrast string, mean_difference double, p double, q double"),),
        "autoregression": (
            make(fits, "subject string, phase string, order int, reason string, stable boolean, whiteness_p double, normality_p double"),
            make(tests, "subject string, phase string, direction string, nominal boolean, fdr boolean"),
            make([("rri_to_sbp", "Stim-Pre", 1.0), ("sbp_to_rri", "Stim-Pre", 0.5)], "direction string, contrast string, p double"),
            make([("rri_to_sbp", None, "not_estimable", "no_within_participant_variation_across_phases"), ("sbp_to_rri", 0.3, "estimable", "NA")], "direction string, p double, status string, reason string"),
        ),
        "branches": (make([("REF", -2.0), ("A0_MAX", -1.0), ("A1_MAX", -0.5)], "setting string, mean_difference double"), make([("REF", "mean", -3.0, -1.0), ("A0_MAX", "mean", -2.0, 1.0)], "setting string, statistic string, low double, high double")),
        "coupling": (make([(m, w, "Stim-Pre", 0.4) for m in ("CE", "LP") for w in ("a", "b")] + [("CE", "a", "Post-Pre", None)], "method string, direction string, contrast string, q double"),),
    }


MAKERS = {
    "central": release.central_values,
    "landscape": lambda e: release.landscape_values(e, "s0", "p"),
    "coherence": release.coherence_values,
    "haemodynamics": release.haemodynamics_values,
    "autoregression": release.autoregression_values,
    "branches": lambda c, i: release.branch_values(c, i, ("A0_MAX", "A1_MAX")),
    "coupling": release.coupling_values,
}
KNOWN = {
    "central": {"n": 4, "mean_difference": -1.375, "negative_participants": 3, "bca95_low": -3, "bca95_high": -0.5, "wilcoxon_p": 0.25, "intervals": 1, "tests": 1},
    "landscape": {"rows": 12, "settings": 4, "settings_up": 4, "reference_all": -2, "median_all": -0.5, "minimum_all": -2, "maximum_all": 1, "all_negative": 2, "up_negative": 4, "down_negative": 2, "all_up_down_negative_total": 8, "positive_all": 1, "evaluable_n_min": 11, "evaluable_n_max": 14, "minimum_p_among_positive_all": 0.5},
    "coherence": {"reference_mean_difference": 0.02, "sensitivity_mean_difference": 0.03, "reference_wilcoxon_p": 0.7, "pre_significant": 14, "stim_significant": 15, "post_significant": 15, "mcnemar_p": 1, "cochran_q_p": 0.846},
    "haemodynamics": {"mean_sbp_stim_minus_pre": 6.1, "wilcoxon_p": 0.005, "bh_q": 0.04, "metrics": 2},
    "autoregression": {"unique_fits": 9, "rows": 9, "succeeded": 9, "stable": 9, "whiteness_pass": 6, "normality_pass": 3, "both_pass": 3, "odd_orders": 0, "direction_rows": 9, "direction_nominal": 9, "direction_fdr": 9, "cochran_not_estimable": 1, "mcnemar_p": 1},
    "branches": {"branches": 2, "rows": 3, "negative_branches": 2, "ref_mean_difference": -2, "ref_low": -3, "ref_high": -1},
    "coupling": {"primary_tests": 4, "primary_families": 4, "primary_below_005": 0},
}


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("known") / "known.json"
    at.write_text(json.dumps(KNOWN | {"notes": {"version": "1.x"}, "text": "7"}))
    return release.read_known(spark, str(at), {("central", "wilcoxon_p"): 5e-3})


def failed(spark, known, check, tables):
    rows = release.against({check: MAKERS[check](*tables)}, known).collect()
    assert len(rows) == len(KNOWN[check])
    return {r["name"].split("/")[1] for r in rows if not r["passed"]}


def test_known_results_pass(spark, known):
    assert known.count() == sum(map(len, KNOWN.values()))
    for check, tables in frames(spark).items():
        assert failed(spark, known, check, tables) == set(), check


PLANTED = [
    ("central", 0, lambda t: t.where("subject <> '3'"), {"n", "mean_difference"}),
    ("central", 0, lambda t: t.withColumn("d", F.abs("d")), {"mean_difference", "negative_participants"}),
    ("central", 1, lambda t: t.withColumn("low", F.col("low") - 0.01), {"bca95_low"}),
    ("central", 2, lambda t: t.withColumn("p", F.col("p") + 0.01), {"wilcoxon_p"}),
    ("landscape", 0, lambda t: t.where("not (setting = 's1' and direction = 'up')"), {"rows", "settings_up", "up_negative", "all_up_down_negative_total"}),
    ("landscape", 0, lambda t: t.withColumn("mean_difference", F.when((F.col("setting") == "s0") & (F.col("direction") == "all"), 1e-5).otherwise(0.0) + F.col("mean_difference")), {"reference_all", "minimum_all"}),
    ("landscape", 0, lambda t: t.union(t.where("setting = 's0' and direction = 'all'")), {"rows", "reference_all", "median_all", "all_negative", "all_up_down_negative_total"}),
    ("landscape", 0, lambda t: t.withColumn("p", F.lit(0.01)), {"minimum_p_among_positive_all"}),
    ("coherence", 0, lambda t: t.where("size = 512"), {"sensitivity_mean_difference"}),
    ("coherence", 1, lambda t: t.withColumn("successes", F.lit(15)), {"pre_significant"}),
    ("coherence", 2, lambda t: t.withColumn("p", F.col("p") / 2), {"mcnemar_p"}),
    ("coherence", 3, lambda t: t.union(t), {"cochran_q_p"}),
    ("haemodynamics", 0, lambda t: t.withColumn("q", F.col("p")), {"bh_q"}),
    ("haemodynamics", 0, lambda t: t.where("metric <> 'mean_sbp'"), {"mean_sbp_stim_minus_pre", "wilcoxon_p", "bh_q", "metrics"}),
    ("autoregression", 0, lambda t: t.withColumn("stable", F.col("subject") != "1"), {"stable"}),
    ("autoregression", 0, lambda t: t.withColumn("order", F.col("order") + 9), {"odd_orders"}),
    ("autoregression", 1, lambda t: t.withColumn("fdr", F.lit(False)), {"direction_fdr"}),
    ("autoregression", 2, lambda t: t.withColumn("p", F.lit(0.9)), {"mcnemar_p"}),
    ("autoregression", 3, lambda t: t.withColumn("p", F.lit(0.9)), {"cochran_not_estimable"}),
    ("branches", 0, lambda t: t.withColumn("mean_difference", F.when(F.col("setting") == "A1_MAX", 0.5).otherwise(F.col("mean_difference"))), {"negative_branches"}),
    ("branches", 0, lambda t: t.where("setting <> 'A0_MAX'"), {"branches", "rows", "negative_branches"}),
    ("branches", 1, lambda t: t.withColumn("high", F.col("high") + 1), {"ref_high"}),
    ("coupling", 0, lambda t: t.withColumn("q", F.when((F.col("method") == "CE") & (F.col("direction") == "a"), 0.01).otherwise(F.col("q"))), {"primary_below_005"}),
    ("coupling", 0, lambda t: t.where("method = 'CE'"), {"primary_tests", "primary_families"}),
]


@pytest.mark.parametrize(("check", "which", "change", "want"), PLANTED, ids=[f"{c}-{sorted(w)[0]}-{i}" for i, (c, _, _, w) in enumerate(PLANTED)])
def test_planted_errors_fail(spark, known, check, which, change, want):
    tables = list(frames(spark)[check])
    tables[which] = change(tables[which])
    assert want <= failed(spark, known, check, tables)


def test_checks_of_a_whole_analysis(spark):
    """The figures of an analysis of the event table are those of its own tables."""
    from rampflow.operators import ramps
    from rampflow.plans.beat_queries import beats
    from rampflow.schema import BRANCHES

    g = ramps.gains(beats(spark, "/root/testdata/sf0.001", "event_type"), BRANCHES).select("setting", "direction", "subject", "phase", "gain")
    e = contrasts.summary(contrasts.differences(g, "gain", "setting", "direction", contrasts=(("Stim", "Pre"),)), "setting", "direction")
    got = {r["name"]: r["value"] for r in release.landscape_values(e, "REF").collect()}
    rows = e.collect()
    assert got["rows"] == len(rows) and got["all_negative"] == sum(r["direction"] == "all" and r["mean_difference"] < 0 for r in rows)
    assert got["reference_all"] == next(r["mean_difference"] for r in rows if r["setting"] == "REF" and r["direction"] == "all")


def test_safe_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "clean.txt").write_text("a table of beats\nmean 1.5\n")
    assert release.safe_tree(spark, str(tmp_path)).where("not passed").count() == 0
    (tmp_path / "a" / "b" / "bad.md").write_text("-----BEGIN RSA PRIVATE KEY-----\nsee /home/someone/x and mail me@example.org\npassword = hunter2hunter2\n")
    bad = {r["name"] for r in release.safe_tree(spark, str(tmp_path)).where("not passed").collect()}
    assert bad == {"private_key", "home_folder", "e_mail", "password"}
    assert {r["name"] for r in release.safe_tree(spark, str(tmp_path), allowed="example.org").where("not passed").collect()} == {"private_key", "password"}
