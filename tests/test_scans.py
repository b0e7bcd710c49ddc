"""Scans over whole tables, runs, pairing in runs, and the job ledger."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampflow.operators import pairing, scans
from rampflow.operators.ledger import resumed
from rampflow.plans import analyses


def keyless_windows(df) -> list[str]:
    """Windows of the plan with an order but no key, other than over the carries, a row a range."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    found = [line[line.index("Window [") :] for line in plan.splitlines() if "Window [" in line]
    return [w for w in found if w.count("], [") == 1 and "_range" not in w.rsplit("], [", 1)[1]]


def benjamini_hochberg(p):
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.sort(p) * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("ties", [1000, 3])
def test_step_up(spark, ties):
    """With ties, nulls and, in the second case, a third of all rows at one value."""
    rng = np.random.default_rng(ties)
    p = np.round(rng.random(400) ** 2, 3) if ties > 10 else rng.choice([0.01, 0.2, 0.9], 400)
    rows = [(i, float(v)) for i, v in enumerate(p)] + [(1000 + i, None) for i in range(9)]
    out = scans.step_up(spark.createDataFrame(rows, "i int, p double").repartition(5), "p", "q")
    got = {r["i"]: r["q"] for r in out.collect()}
    assert len(got) == 409 and all(got[1000 + i] is None for i in range(9))
    assert [got[i] for i in range(400)] == pytest.approx(benjamini_hochberg(p))
    assert keyless_windows(out) == []


def test_step_up_in_families(spark):
    rng = np.random.default_rng(2)
    rows = [(f, i, float(v)) for f, n in (("a", 50), (None, 30), ("b", 1)) for i, v in enumerate(np.round(rng.random(n), 2))]
    got = scans.step_up(spark.createDataFrame(rows, "f string, i int, p double"), "p", "q", "f").collect()
    for f in ("a", None, "b"):
        mine = sorted((r["i"], r["p"], r["q"]) for r in got if r["f"] == f)
        assert [q for *_, q in mine] == pytest.approx(benjamini_hochberg(np.array([p for _, p, _ in mine])))
    assert scans.step_up(spark.createDataFrame([], "f string, p double"), "p", "q").collect() == []


def test_places(spark):
    rng = np.random.default_rng(5)
    rows = [(float(v), f"{i:03}") for i, v in enumerate(rng.integers(0, 40, 300))] + [(None, "zz"), (None, "za")]
    out = scans.places(spark.createDataFrame(rows, "v double, name string").repartition(6), "v", "name")
    got = [(r["v"], r["name"]) for r in out.orderBy("place").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])) and keyless_windows(out) == []


def test_runs(spark):
    rng = np.random.default_rng(6)
    rows = sorted({(k, int(v)) for k in ("a", "b") for v in rng.integers(-200, 400, 350)})
    got = {(r["k"], r["v"]): r["run"] for r in scans.runs(spark.createDataFrame(rows, "k string, v long").repartition(5), "k", "v").collect()}
    want = {}
    for k, v in rows:
        want[k, v] = want.get((k, v - 1), v)
    assert got == want


def plain_pairs(left, right, within):
    out, j = [], 0
    left, right = sorted(left), sorted(right)
    for x in left:
        while j < len(right) and right[j] < x:
            j += 1
        if j < len(right) and right[j] <= x + within:
            out.append((x, right[j]))
            j += 1
    return out


@pytest.mark.parametrize("density", [0.05, 1.0, 8.0])
def test_one_to_one_in_runs(spark, density):
    """One key of all rows, sparse and dense, with equal times."""
    rng = np.random.default_rng(7)
    n = 600
    left, right = (np.round(rng.random(n) * n / density, 1).tolist() for _ in range(2))
    frame = lambda t: spark.createDataFrame([("k", v) for v in t], "subject string, t double").repartition(4)
    got = [(r["t_left"], r["t_right"]) for r in pairing.one_to_one(frame(left), frame(right), 0.5).orderBy("t_left", "t_right").collect()]
    assert got == plain_pairs(left, right, 0.5)
    if density < 1:
        runs = scans.runs(frame(left).select("subject", F.floor(F.col("t") / 0.5).alias("b")).distinct(), "subject", "b")
        assert runs.select("run").distinct().count() > 100


def test_ledger_runs_a_job_once(spark, tmp_path):
    """A run that fails keeps the waves before; the next one runs only what is missing, and a third nothing."""
    jobs = spark.range(40).select(F.col("id").alias("job"), (F.col("id") * 2).alias("x"))
    path, last = str(tmp_path / "ledger"), F.pmod(F.xxhash64("job"), F.lit(4)) == 3
    poison = lambda where: lambda df: df.select("job", F.when(where, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("x") + 1).alias("y"))
    with pytest.raises(Exception, match="stop"):
        resumed(jobs, ["job"], poison(last), path, waves=4).collect()
    done = {r["job"] for r in spark.read.parquet(path).collect()}
    assert 0 < len(done) < 40
    again = resumed(jobs, ["job"], poison(F.col("job").isin(sorted(done))), path, waves=4)  # fails if a finished job is run
    assert sorted((r["job"], r["y"]) for r in again.collect()) == [(i, 2 * i + 1) for i in range(40)]
    assert resumed(jobs.limit(5), ["job"], poison(F.lit(True)), path, waves=4).count() == 5


def test_shift_tests_with_a_ledger(spark, tmp_path):
    """Equal results with and without; a changed series or option is another job; failures are named."""
    rng = np.random.default_rng(8)
    rows = [(s, "Pre", i + 1, float(i), float(800 + rng.normal()), float(120 + rng.normal())) for s in ("1", "2") for i in range(90)]
    rows += [("3", "Pre", i + 1, float(i), float(800 + rng.normal()), 120.0) for i in range(90)] + [("4", "Pre", i + 1, float(i), 800.0 + i % 7, 120.0 + i % 5) for i in range(20)]
    beats = spark.createDataFrame(rows, "subject string, phase string, beat_idx int, t double, rri double, sbp double")
    path = str(tmp_path / "ledger")
    run = lambda d, **o: sorted(map(str, analyses.shift_tests(d, ("SSC", "LP"), count=7, **o).collect()))
    plain = run(beats)
    assert run(beats, ledger=path) == plain and run(beats, ledger=path) == plain
    n = spark.read.parquet(path).count()
    assert n == 4 * 2 * 2
    run(beats.where("subject = '1'"), ledger=path)
    assert spark.read.parquet(path).count() == n
    run(beats.where("subject = '1'").withColumn("sbp", F.col("sbp") * F.col("beat_idx")), ledger=path)
    assert spark.read.parquet(path).count() == n + 4
    got = {(r["subject"], r["method"], r["direction"]): r for r in analyses.shift_tests(beats, ("SSC", "LP"), count=7).collect()}
    assert got["1", "LP", "sbp_to_rri"]["evaluable"] and got["1", "LP", "sbp_to_rri"]["p"] * 8 == int(got["1", "LP", "sbp_to_rri"]["p"] * 8)
    assert not got["3", "LP", "sbp_to_rri"]["evaluable"] and got["3", "LP", "sbp_to_rri"]["reason"] == "invalid or short input"
    assert got["4", "SSC", "rri_to_sbp"]["reason"] == "a series this short has no shift" and not got["4", "SSC", "rri_to_sbp"]["significant"]
