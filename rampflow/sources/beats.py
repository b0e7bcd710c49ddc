"""Beat tables: readers of the file layouts and adapters from keyed event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from ..schema import BEAT_HEADER, PAIRED_HEADER

#: Events of one task, about, in a table of more than twice as many.
PER_TASK = 1 << 17
FILE_NAME = r"S(\d{2})_(Pre|Stim|Post)\.csv$"


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Every cell as text, nothing taken for null; a byte-order mark in front of the first header goes."""
    df = spark.read.options(header=True, sep=sep, inferSchema=False, nullValue="\u0001", emptyValue="", quote='"', escape='"').csv(path)
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns]).na.fill("")  # an empty cell is empty, not missing


def read_beat_files(spark: SparkSession, folder: str) -> DataFrame:
    """Headered files S##_Phase.csv as beats; subject and phase come from the file name."""
    raw = spark.read.schema("beat_idx int, rri double, sbp double, pat double").option("header", True).csv(f"{folder}/*.csv")
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    return raw.select(
        F.concat(F.lit("S"), F.regexp_extract(name, FILE_NAME, 1)).alias("subject"),
        F.regexp_extract(name, FILE_NAME, 2).alias("phase"),
        "beat_idx",
        F.lit(None).cast("double").alias("t"),
        "rri",
        "sbp",
    )


def validated_beat_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per file: what breaks the contract of public beat tables (counts; all 0 in a good file)."""
    raw = spark.read.schema(", ".join(f"{c} string" for c in BEAT_HEADER)).option("header", True).option("enforceSchema", False).csv(f"{folder}/*.csv")
    n = {c: F.expr(f"try_cast({c} as {'int' if c == 'beat_idx' else 'double'})") for c in BEAT_HEADER}
    bad = lambda c, lo, hi: F.count_if(~F.coalesce(finite(n[c]) & (n[c] > lo) & (n[c] < hi), F.lit(False)))
    name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
    checked = raw.groupBy(name.alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(n["beat_idx"].isNull()).alias("bad_index"),
        (F.max(n["beat_idx"]) - F.count_distinct(n["beat_idx"])).cast("long").alias("index_gaps"),
        bad("RRI_ms", 200, 3000).alias("bad_rri"),
        bad("SBP_mmHg", 40, 260).alias("bad_sbp"),
        F.count_if(~F.coalesce(finite(n["PAT_ms"]), F.lit(False))).alias("bad_pat"),
    )
    return checked.withColumn("bad_name", (~F.col("file").rlike(r"^S(0[1-9]|1[0-8])_(Pre|Stim|Post)\.csv$")).cast("int")).withColumn("bad_rows", (~F.col("rows").between(100, 2000)).cast("int"))


def read_paired_files(spark: SparkSession, path: str) -> DataFrame:
    """Headerless paired-beat files: the five columns, beat time in seconds, pressure in mmHg, and row number from 0 and from 1.

    The row number follows time, as rows of a distributed read have no order of their own.
    """
    raw = spark.read.schema(", ".join(f"{c} double" for c in PAIRED_HEADER)).option("header", False).csv(path)
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    by_time = Window.partitionBy("file").orderBy("R_wave_timing_ms")
    return raw.select(
        "*",
        (F.col("R_wave_timing_ms") / 1000.0).alias("beat_time_s"),
        (F.col("sBP_mmHg100") * 100.0).alias("sbp_mmhg"),
        (F.row_number().over(by_time) - 1).alias("source_row"),
        F.row_number().over(by_time).alias("original_row"),
    )


def file_hashes(spark: SparkSession, path: str, end_of_line: bool = False) -> DataFrame:
    """path, size, SHA-256 of files; with ``end_of_line`` of their content with all line ends as LF."""
    files = spark.read.format("binaryFile").load(path)
    content = F.col("content")
    if end_of_line:
        text = F.decode(content, "ISO-8859-1")
        content = F.encode(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "ISO-8859-1")
    return files.select("path", "modificationTime", F.col("length").alias("size_bytes"), F.sha2(content, 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path)


def tasks_of(events: DataFrame) -> int:
    """Tasks over which a table of events is dealt, so that what one holds doesn't grow with the table; 0 for a small one."""
    n = events.count() // PER_TASK  # of Parquet the footers tell
    return max(n, events.sparkSession.sparkContext.defaultParallelism) if n > 1 else 0


def _cuts(e: DataFrame) -> DataFrame | None:
    """(subject, _cuts) of every subject of more than ``PER_TASK`` events: times that cut it into slices of about as many; None if there is none."""
    most = e.groupBy("subject").count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // PER_TASK)
    if parts < 2:
        return None
    cuts = F.percentile_approx("us", [i / parts for i in range(1, parts)], 20 * parts)
    return e.groupBy("subject").agg(F.count(F.lit(1)).alias("_n"), cuts.alias("_cuts")).where(F.col("_n") > PER_TASK).drop("_n")


def event_beats(events: DataFrame, key: str, hours: float = 3.6e9) -> DataFrame:
    """Beats from a keyed event table: value as pressure, the gap to the previous event (in hours) as interval.

    Phases are the half-open thirds of January 2024. A key's first event has no gap and goes (validity
    filter); beats are numbered from 1 in each (subject, phase) by time and event id. In a large table a key of many events is cut into
    slices of time; what crosses them is the last event of the slice before, and the number of beats of all before.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.select(F.col(key).cast("string").alias("subject"), "ts", "event_id", us.alias("us"), F.col("value").alias("sbp"))
    tasks = tasks_of(events)
    cuts = _cuts(e) if tasks else None
    part, before, earlier = ["subject"], F.lit(None).cast("long"), F.lit(0)
    if cuts is not None:
        part = ["subject", "_slice"]
        e = e.join(F.broadcast(cuts), "subject", "left").withColumn("_slice", F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col("us")))))
        e = e.drop("_cuts").repartition(tasks, *part)  # a short subject has no slices: null
        ends = e.where("_slice is not null").groupBy(*part).agg(F.max("us").alias("_end"))
        ends = ends.select(*part, F.lag("_end").over(Window.partitionBy("subject").orderBy("_slice")).alias("_end"))  # over a row a slice
        e, before = e.join(F.broadcast(ends), part, "left"), F.col("_end")
    elif tasks > events.sparkSession.sparkContext.defaultParallelism:
        e = e.repartition(tasks, "subject")
    e = e.withColumn("rri", (F.col("us") - F.coalesce(F.lag("us").over(Window.partitionBy(*part).orderBy("ts", "event_id")), before)) / F.lit(hours))
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    e = e.withColumn("phase", F.when(F.col("ts") < day("11"), "Pre").when(F.col("ts") < day("21"), "Stim").otherwise("Post"))
    e = e.where(finite(F.col("rri")) & finite(F.col("sbp")) & (F.col("rri") > 0))
    if cuts is not None:
        upto = Window.partitionBy("subject", "phase").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        n = e.where("_slice is not null").groupBy(*part, "phase").agg(F.count(F.lit(1)).alias("_n"))
        e = e.join(F.broadcast(n.select(*part, "phase", F.sum("_n").over(upto).alias("_n"))), [*part, "phase"], "left")
        earlier = F.coalesce("_n", F.lit(0))
    number = F.row_number().over(Window.partitionBy(*part, "phase").orderBy("us", "event_id")) + earlier
    return e.select("subject", "phase", number.cast("int").alias("beat_idx"), (F.col("us") / F.lit(1e6)).alias("t"), "rri", "sbp")
