"""Descriptive figures of cells, phases and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ratio
from ..functions.dist import t_ppf
from ..schema import CELL
from .grouped import per_row


def context(beats: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """n, duration, means and SDs of interval, rate and pressure, and RMSSD of every cell."""
    w = Window.partitionBy(*cell).orderBy("beat_idx")
    rows = beats.withColumn("_d", F.col("rri") - F.lag("rri").over(w))
    return rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_beats"),
        (F.max("t") - F.min("t")).alias("duration"),
        F.avg("rri").alias("mean_rri"),
        F.avg(F.try_divide(F.lit(60000.0), F.col("rri"))).alias("mean_hr"),
        F.avg("sbp").alias("mean_sbp"),
        F.stddev_samp("rri").alias("sd_rri"),
        F.stddev_samp("sbp").alias("sd_sbp"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"),
    )


def descriptives(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, SD, median and quartiles of a column; percentiles interpolate linearly."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median"), q.alias("_q"))
    return out.withColumns({"q1": F.col("_q")[0], "q3": F.col("_q")[1], "iqr": F.col("_q")[1] - F.col("_q")[0]}).drop("_q")


def trajectory(binned: DataFrame, value: str, level: float = 0.975) -> DataFrame:
    """Per bin over subjects: n, mean, SEM and t interval; no interval for one subject."""
    by_subject = binned.groupBy("subject", "bin").agg(F.avg(value).alias("_v"))
    out = by_subject.groupBy("bin").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), ratio(F.stddev_samp("_v"), F.sqrt(F.count("_v"))).alias("sem"))
    points = per_row(out.select("n").where("n > 1").distinct(), ["n"], lambda key: (t_ppf(level, int(key[0]) - 1),), "t double")
    out = out.join(points, "n", "left")
    half = F.col("t") * F.col("sem")
    return out.select("bin", "n", "mean", "sem", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))
