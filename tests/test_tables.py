"""Readers, sinks, segments, pairing, audits, streams, and all registered queries against DuckDB."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from rampflow.operators import audit, context, pairing, segment
from rampflow.plans import registry
from rampflow.schema import WINDOWS, windows_frame
from rampflow.sources import beats as sources
from rampflow.sources import identity, reports, sinks
from rampflow import streaming
from rampflow.streaming import online_ramps, tumbling_bins

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name in registry.oracle_sql():
        res = duck.execute(registry.oracle_sql()[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
        assert got == want


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode())


def test_beat_files(spark, tmp_path):
    good = "beat_idx,RRI_ms,SBP_mmHg,PAT_ms\n" + "".join(f"{i},{800 + i},{120 + i % 5},50\n" for i in range(1, 121))
    bad = "beat_idx,RRI_ms,SBP_mmHg,PAT_ms\n1,100,120,5\n3,x,500,NA\n"
    write(tmp_path / "b", "S01_Pre.csv", good)
    write(tmp_path / "b", "S19_Stim.csv", bad)
    b = sources.read_beat_files(spark, f"{tmp_path}/b").where("subject = 'S01'")
    assert b.count() == 120 and b.first()["phase"] == "Pre"
    checks = {r["file"]: r.asDict() for r in sources.validated_beat_files(spark, f"{tmp_path}/b").collect()}
    assert all(v == 0 for k, v in checks["S01_Pre.csv"].items() if k not in ("file", "rows"))
    worst = checks["S19_Stim.csv"]
    assert (worst["bad_rri"], worst["bad_sbp"], worst["bad_pat"], worst["index_gaps"], worst["bad_name"], worst["bad_rows"]) == (2, 1, 1, 1, 1, 1)


def test_paired_files(spark, tmp_path):
    write(tmp_path / "p", "a.csv", "2000,800,2300,1.2,300\n1000,790,1300,1.1,300\n")
    rows = sources.read_paired_files(spark, f"{tmp_path}/p").orderBy("source_row").collect()
    assert [(r["beat_time_s"], r["sbp_mmhg"], r["source_row"]) for r in rows] == [(1.0, pytest.approx(110.0), 0), (2.0, pytest.approx(120.0), 1)]


def test_text_tables_and_hashes(spark, tmp_path):
    write(tmp_path / "t", "x.csv", "\ufeffname,value\r\nNA,\r\n\"a,b\",1\r\n")
    df = sources.read_text_table(spark, f"{tmp_path}/t/x.csv")
    assert df.columns == ["name", "value"] and [tuple(r) for r in df.collect()] == [("NA", ""), ("a,b", "1")]
    raw = (tmp_path / "t/x.csv").read_bytes()
    h = sources.file_hashes(spark, f"{tmp_path}/t/x.csv").first()
    assert (h["size_bytes"], h["sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert sources.file_hashes(spark, f"{tmp_path}/t/x.csv", True).first()["sha256"] == hashlib.sha256(raw.replace(b"\r\n", b"\n")).hexdigest()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1, None), ("b", float("nan"), 2)], "k string, x double, n int")
    sinks.write_table(df, f"{tmp_path}/out/t", f"{tmp_path}/out", exact=True)
    a, b = (tuple(r) for r in sources.read_text_table(spark, f"{tmp_path}/out/t").orderBy("k").collect())
    assert (a[0], float(a[1]), a[2]) == ("a", 0.1, "NA") and b == ("b", "NA", "2")
    with pytest.raises(ValueError, match="not under"):
        sinks.write_table(df, f"{tmp_path}/out/../else", f"{tmp_path}/out")
    with pytest.raises(ValueError, match="blank"):
        sinks.write_table(df.withColumn("k", F.lit(" ")), f"{tmp_path}/out/u", f"{tmp_path}/out", strict=True)


@pytest.mark.parametrize("border", [300.0, 450.0, 600.0, 750.0])
def test_windows_are_half_open(spark, border):
    t = [border + d for d in (-0.3, -0.2, -0.1, 0.0, 0.1, 0.2)]
    df = spark.createDataFrame([(x,) for x in t], "t double")
    kind = "phase" if border in (300.0, 600.0) else "subphase"
    names = [r["window"] for r in segment.in_windows(df, windows_frame(spark, kind)).orderBy("t").collect()]
    assert names[:3] == names[:1] * 3 and names[3:] == names[3:4] * 3 and names[0] != names[3]
    assert next(hi for n, lo, hi in WINDOWS[kind] if n == names[0]) == border


def test_validity_counts(spark):
    rows = [("1", "Pre", 1, 800.0, 120.0), ("1", "Pre", 2, None, 120.0), ("1", "Pre", 3, -1.0, 120.0), ("1", "Pre", 4, 800.0, float("nan"))]
    r = segment.phase_counts(spark.createDataFrame(rows, "subject string, phase string, beat_idx int, rri double, sbp double")).first()
    assert (r["n_rows"], r["n_valid"], r["n_missing"], r["first_row"], r["last_row"]) == (4, 1, 3, 1, 1)


def test_context(spark):
    rows = [("1", "Pre", i + 1, float(i), r, 120.0 + i) for i, r in enumerate((1000.0, 500.0, 1000.0))]
    r = context.context(spark.createDataFrame(rows, "subject string, phase string, beat_idx int, t double, rri double, sbp double")).first()
    assert r["mean_hr"] == pytest.approx(80.0) and r["rmssd"] == pytest.approx(500.0) and r["sd_sbp"] == pytest.approx(1.0)


def test_pairing(spark):
    left = spark.createDataFrame([("1", x) for x in (0.0, 0.2, 1.0, 5.0)], "subject string, t double")
    right = spark.createDataFrame([("1", x) for x in (0.3, 0.9, 1.5)], "subject string, t double")
    many = [(r["t_left"], r["t_right"]) for r in pairing.first_follower(left, right, 0.5).orderBy("t_left").collect()]
    assert many == [(0.0, 0.3), (0.2, 0.3), (1.0, 1.5)]
    once = [(r["t_left"], r["t_right"]) for r in pairing.one_to_one(left, right, 0.5).orderBy("t_left").collect()]
    assert once == [(0.0, 0.3), (1.0, 1.5)]
    assert [r["in_order"] for r in pairing.in_order(pairing.first_follower(left, right, 0.5)).collect()] == [False]
    assert [r["in_order"] for r in pairing.in_order(pairing.one_to_one(left, right, 0.5)).collect()] == [True]


def test_audit(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-12), ("y", None)], "k string, v double")
    checks = audit.all_checks(
        audit.close(a, b, ["k"], ["v"], 1e-9, "close"),
        audit.same_keys(a, b, ["k"], "keys"),
        audit.no_blanks(a.select("k", F.lit("t").alias("t")), "blanks"),
        audit.forbidden(a.select(F.col("k").alias("value")), {"no z": "z"}),
    )
    audit.require(checks)
    with pytest.raises(AssertionError, match="far"):
        audit.require(audit.close(a, b.withColumn("v", F.lit(2.0)), ["k"], ["v"], 1e-9, "far"))


def run_stream(spark, df, query_of, folder, mode="append"):
    df.write.parquet(str(folder))
    stream = spark.readStream.schema(df.schema).parquet(str(folder))
    name = f"out_{abs(hash(str(folder)))}"
    q = query_of(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name)


def test_streamed_bins_equal_the_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at + dt.timedelta(seconds=7 * i), float(i % 11)) for i in range(200)], "ts timestamp_ntz, value double")
    got = run_stream(spark, df, lambda s: tumbling_bins(s, "30 seconds"), tmp_path / "e", "complete")
    want = tumbling_bins(df, "30 seconds")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


PHASED = [("Pre", 0.0, 300.0), ("Stim", 300.0, 600.0), ("Post", 600.0, 900.0)]


def phased_beats(seed=3, subjects=4):
    """(subject, t, sbp, rri) of three phases a subject, with some beats of no phase."""
    import random

    r = random.Random(seed)
    out = []
    for s in range(subjects):
        t = -2.0
        while t < 905:
            t += r.choice([0.7, 0.8, 0.9, 1.1])
            out.append((str(s), round(t, 3), round(r.uniform(100, 106), 2), round(r.uniform(700, 760), 2)))
    return out


def stream_of(spark, batches, folder, late, phases=PHASED):
    """Ramps of batches that come one by one, a file each."""
    schema = "subject string, t double, sbp double, rri double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i}")
    plain = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    streaming.use_rocksdb(spark)
    try:
        # Files are taken in order of their names, a file a batch.
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
        q = online_ramps(stream, phases, late).writeStream.format("memory").queryName(f"r{abs(hash(folder))}").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(f"r{abs(hash(folder))}").collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", plain)


def batch_ramps(spark, rows):
    from dataclasses import replace

    from pyspark.sql.window import Window

    from rampflow.operators import ramps, segment
    from rampflow.schema import CANONICAL, windows_frame

    b = segment.in_windows(spark.createDataFrame(rows, "subject string, t double, sbp double, rri double"), windows_frame(spark, "phase")).withColumnRenamed("window", "phase")
    b = b.withColumn("beat_idx", F.row_number().over(Window.partitionBy("subject", "phase").orderBy("t"))).select("subject", "phase", "beat_idx", "t", "rri", "sbp")
    found = ramps.held(ramps.sequences(b, (replace(CANONICAL, lag=0),)), b)
    return found.select("subject", "phase", "direction", F.col("sbp_times")[0].alias("start_t"), F.element_at("sbp_times", -1).alias("end_t"), "n_beats", "slope").collect()


def ramp_keys(rows):
    return sorted((r[0], r[1], r[2], r[3], r[4], r[5], round(r[6], 6)) for r in rows)


def test_streamed_ramps_equal_the_batch(spark, tmp_path):
    """Batches in order, beats of a batch in any order, and a beat after the last phase that moves the watermark: the last ramps come too."""
    import random

    rows = phased_beats()
    batches = [[r for r in rows if lo <= r[1] < lo + 150] for lo in range(-150, 1050, 150)]
    for b in batches:
        random.Random(1).shuffle(b)
    got = stream_of(spark, [*(b for b in batches if b), [("0", 5_000.0, 100.0, 700.0)]], tmp_path, "10 seconds")
    want = batch_ramps(spark, rows)
    assert ramp_keys(got) == ramp_keys(want) and len(got) > 100
    last = {(r[0], r[1]): max(x[4] for x in want if x[:2] == r[:2]) for r in want}
    assert all(any(g[0] == s and g[1] == p and g[4] == t for g in got) for (s, p), t in last.items())


def test_streamed_ramps_of_unordered_and_late_beats(spark, tmp_path):
    """Beats that come up to a minute behind change nothing; one that comes later than that is not looked at."""
    rows = [r for r in phased_beats(4, 2) if r[1] < 400]
    early, late = [r for r in rows if int(r[1] * 10) % 7], [r for r in rows if not int(r[1] * 10) % 7]
    batches = []
    for lo in range(-50, 450, 50):  # a seventh of all beats come with the next batch
        batches.append([r for r in early if lo <= r[1] < lo + 50] + [r for r in late if lo - 50 <= r[1] < lo])
    too_late = [("0", 100.0005, 500.0, 700.0), ("0", 100.0015, 600.0, 800.0), ("0", 100.0025, 700.0, 900.0)]
    got = stream_of(spark, [*(b for b in batches if b), [("0", 2_000.0, 100.0, 700.0)], too_late, [("0", 9_000.0, 100.0, 700.0)]], tmp_path, "150 seconds")
    assert ramp_keys(got) == ramp_keys(batch_ramps(spark, rows)) and not any(r[5] and r[3] >= 100.0005 and r[4] <= 100.0025 for r in got)


def test_file_identity(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("01", "02"):
        (tmp_path / "in" / f"paired_beats_{n}.csv").write_text(f"x{n}\n")
    digest = lambda n: hashlib.sha256(f"x{n}\n".encode()).hexdigest()
    inventory = spark.createDataFrame([("data/paired_beats_01.csv", digest("01").upper()), ("data/paired_beats_02.csv", "0" * 64), ("data/paired_beats_03.csv", digest("03")), ("data/other.txt", "1")], "path string, sha256 string")
    expected = identity.expected_hashes(inventory, r"paired_beats_\d{2}\.csv")
    got = {r["file_name"]: (r["hash_match"], r["observed"] == "NA") for r in identity.identity(expected, sources.file_hashes(spark, f"{tmp_path}/in")).collect()}
    assert got == {"paired_beats_01.csv": (True, False), "paired_beats_02.csv": (False, False), "paired_beats_03.csv": (False, True)}
    lines = [r["value"] for r in sinks.checksum_lines(sources.file_hashes(spark, f"{tmp_path}/in"), f"{tmp_path}/in").collect()]
    assert lines == [f"{digest(n)}  paired_beats_{n}.csv" for n in ("01", "02")]


def test_hash_entries(spark):
    one = lambda text: spark.createDataFrame([(text,)], "entries string")
    got = identity.hash_entries(one('{"a": "ab12", "b": {"sha256": "cd34", "mode": "eol_normalized_lf_bytes"}}')).collect()
    assert {(r["name"], r["sha256"], r["mode"]) for r in got} == {("a", "AB12", "raw_bytes"), ("b", "CD34", "eol_normalized_lf_bytes")}
    for bad in ('{"b": {"sha256": "cd34", "mode": "other"}}', '{"b": {"mode": "raw_bytes"}}'):
        with pytest.raises(Exception, match="not a hash entry"):
            identity.hash_entries(one(bad)).collect()


def test_archive_and_report(spark, tmp_path):
    for name in ("a", "b"):
        reports.write_archive(str(tmp_path / f"{name}.zip"), {"y.txt": b"2", "x.txt": b"1"} if name == "a" else {"x.txt": b"1", "y.txt": b"2"})
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    text = reports.assemble("Title", [("Table", spark.createDataFrame([(1, None)], "a int, b string")), ("Note", "words")])
    assert text == "# Title\n\n## Table\n\n| a | b |\n| --- | --- |\n| 1 | NA |\n\n## Note\n\nwords\n"


def test_comparison_needs_all_cells(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "k string, v double")
    same = lambda b: audit.close(a, b, ["k"], ["v"], 1e-9, "c").first()["passed"]
    assert same(a) and not same(a.where("k = 'x'")) and not same(a.union(spark.createDataFrame([("z", 1.0)], "k string, v double")))
    assert audit.close(a.limit(0), a.limit(0), ["k"], ["v"], 1e-9, "c").first()["passed"]


@pytest.mark.parametrize("key", ["event_type", "user_id"])
def test_a_large_table_is_dealt_over_tasks(spark, monkeypatch, key):
    """Long keys in slices of time and short ones by key hold the same beats; with equal times, gaps of nothing and odd values among them."""
    from rampflow.sources import beats as source

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    twice = e.withColumns({"event_id": F.col("event_id") + 100000, "value": F.when(F.col("event_id") % 7 > 0, F.col("value"))})
    e = e.unionByName(twice).unionByName(e.limit(3).withColumns({key: F.lit("77"), "event_id": F.col("event_id") + 200000}))
    rows = lambda: sorted(map(str, source.event_beats(e, key).collect()))
    want = rows()
    monkeypatch.setattr(source, "PER_TASK", 50)
    got = source.event_beats(e, key)
    assert len(want) > 500 and rows() == want
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > (5 if key == "event_type" else 10)


@pytest.mark.parametrize("name", ["setting_id_codec", "brs_full_factorial", "factorial_summary", "family_check", "jackknife_means", "paired_contrasts", "sign_agreement", "wilcoxon_p"])
def test_query_of_a_large_table_equals_sql(spark, duck, monkeypatch, name):
    """As if events were many: dealt over tasks, keys of many in slices of time and their cells in blocks."""
    from rampflow.operators import ramps
    from rampflow.sources import beats as source

    monkeypatch.setattr(source, "PER_TASK", 50)
    monkeypatch.setattr(ramps, "SPAN", 16)
    assert source.tasks_of(spark.read.parquet(f"{SF}/events.parquet")) > 10
    test_query_equals_sql(spark, duck, name)


@pytest.mark.parametrize("name", ["bland_altman", "paired_contrasts"])
def test_settings_need_no_python_worker(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
