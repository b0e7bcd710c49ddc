"""Waveforms and event files of the stage before beats: slices, peaks, intervals, uniform tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import per_group
from .kernels import spectral

#: Spacing in seconds and number of rows of the uniform table.
SPACING, ROWS = 30 / 64, 1921


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Headerless files of (seconds, value): time in milliseconds, value, and file name."""
    raw = spark.read.schema("s double, value double").option("header", False).csv(path)
    return raw.select(F.col("_metadata.file_name").alias("file"), (F.col("s") * 1000.0).alias("t_ms"), "value")


def slice_samples(wave: DataFrame, first: int, last: int, index: str = "i") -> DataFrame:
    """Samples first..last, ends included."""
    return wave.where(F.col(index).between(first, last))


def find_peaks(wave: DataFrame, column: str, height: float, distance: int, invert: bool = False, key: str = "subject") -> DataFrame:
    """Peaks of a sampled wave(key, i, t, column) per key, or troughs with ``invert``."""
    sign = -1.0 if invert else 1.0

    def kernel(_, i, t, x):
        return [(int(i[k]), float(t[k]), float(x[k])) for k in spectral.peaks(sign * x, height, distance)]

    return per_group(wave, [key], ["i"], ["i", "t", column], kernel, "at long, t double, height double")


def intervals(peaks: DataFrame, key: str = "subject") -> DataFrame:
    """Interval to the next peak in seconds, its middle, and rate per minute; the last peak has none."""
    gap = F.lead("t").over(Window.partitionBy(key).orderBy("t")) - F.col("t")
    return peaks.withColumn("rr", gap).where("rr is not null").withColumns({"t_middle": F.col("t") + F.col("rr") / 2, "hr": F.try_divide(F.lit(60.0), F.col("rr"))})


def pressures(systolic: DataFrame, diastolic: DataFrame, key: str = "subject") -> DataFrame:
    """Pulse pressure and mean pressure of the n-th pair of peaks: PP / 3 + DBP."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("t"))
    s = systolic.select(key, nth.alias("n"), F.col("height").alias("sbp"))
    d = diastolic.select(key, nth.alias("n"), F.col("height").alias("dbp"))
    return s.join(d, [key, "n"]).withColumn("pp", F.col("sbp") - F.col("dbp")).withColumn("map", F.col("pp") / 3 + F.col("dbp"))


def uniform_table(series: DataFrame, columns: list[str], key: str = "subject") -> DataFrame:
    """Columns by not-a-knot splines at 0, 30/64, ... seconds: ROWS rows per key, or as many more as the series is long.

    ``outside`` marks points before the first or after the last time, where the outermost cubics go on.
    """

    def kernel(_, t, *xs):
        grid = np.arange(max(ROWS, int(np.floor(t[-1] / SPACING)) + 1)) * SPACING
        made = [spectral.cubic_spline(t, x, grid, "not-a-knot") for x in xs]
        out = (grid < t[0]) | (grid > t[-1])
        return [(i, float(g), *(float(m[i]) for m in made), bool(out[i])) for i, g in enumerate(grid)]

    return per_group(series, [key], ["t"], ["t", *columns], kernel, ", ".join(["i int", "at double", *(f"{c}_uniform double" for c in columns), "outside boolean"]))


def band_correlation(uniform: DataFrame, x: str, y: str, lo: float, hi: float, size: int = 256, key: str = "subject") -> DataFrame:
    """Both columns band-passed; per window of ``size`` samples the largest correlation of x with -y and its lag."""

    def kernel(_, a, b):
        rho, lag = spectral.sliding_correlation(spectral.chebyshev_band(a, lo, hi), -spectral.chebyshev_band(b, lo, hi), size)
        return [(int(i), float(r), int(k)) for i, (r, k) in enumerate(zip(rho, lag, strict=True))]

    return per_group(uniform, [key], ["i"], [x, y], kernel, "start int, rho double, lag int")
