"""Windows of time and beats: phase filters, validity, centred segments, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite
from ..schema import CELL


def valid(rri: Column, sbp: Column) -> Column:
    return F.coalesce(finite(rri) & finite(sbp) & (rri > 0), F.lit(False))


def phase_counts(beats: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Rows, valid and missing pairs, first and last row numbers of every cell."""
    ok = valid(F.col("rri"), F.col("sbp"))
    return beats.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).alias("n_valid"),
        F.count_if(~ok).alias("n_missing"),
        F.min(F.when(ok, F.col("beat_idx"))).alias("first_row"),
        F.max(F.when(ok, F.col("beat_idx"))).alias("last_row"),
    )


def in_windows(beats: DataFrame, windows: DataFrame, t: str = "t") -> DataFrame:
    """Beats with the half-open window [lo, hi) that holds them; ``windows`` has at most a few dozen rows."""
    w = F.broadcast(windows)
    return beats.join(w, (F.col(t) >= F.col("lo")) & (F.col(t) < F.col("hi")))


def binned(beats: DataFrame, width: float, t: str = "t") -> DataFrame:
    """Equal bins by arithmetic: no join."""
    return beats.withColumn("bin", F.floor(F.col(t) / width).cast("long"))


def centred(beats: DataFrame, length: int, cell: list[str] = CELL) -> DataFrame:
    """The stretch of ``length`` beats whose middle time is nearest to the cell's; the earliest of equals."""
    w = Window.partitionBy(*cell).orderBy("beat_idx")
    whole = Window.partitionBy(*cell)
    rows = beats.withColumns({"_end": F.lead("t", length - 1).over(w), "_mid": (F.min("t").over(whole) + F.max("t").over(whole)) / 2, "_n": F.row_number().over(w)})
    far = F.when(F.col("_end").isNotNull(), F.abs((F.col("t") + F.col("_end")) / 2 - F.col("_mid")))
    rows = rows.withColumn("_start", F.min_by("_n", F.when(far.isNotNull(), F.struct(far, "_n"))).over(whole))
    return rows.where((F.col("_n") >= F.col("_start")) & (F.col("_n") < F.col("_start") + length)).drop("_end", "_mid", "_n", "_start")


def differences(beats: DataFrame, column: str, cell: list[str] = CELL) -> DataFrame:
    w = Window.partitionBy(*cell).orderBy("beat_idx")
    return beats.withColumn("step", F.col(column) - F.lag(column).over(w)).where("step is not null")


def detrended(beats: DataFrame, column: str, ddof: int, cell: list[str] = CELL) -> DataFrame:
    """``z``: the column less its line over beat numbers, divided by the SD (population for ddof 0, sample for 1)."""
    whole = Window.partitionBy(*cell)
    b, a = F.regr_slope(column, "beat_idx").over(whole), F.regr_intercept(column, "beat_idx").over(whole)
    rows = beats.withColumn("_d", F.col(column) - a - b * F.col("beat_idx"))
    sd = F.stddev_samp("_d").over(whole) if ddof else F.stddev_pop("_d").over(whole)
    return rows.withColumn("z", F.try_divide(F.col("_d") - F.avg("_d").over(whole), sd)).drop("_d")


def lagged(beats: DataFrame, column: str, lags: int, cell: list[str] = CELL) -> DataFrame:
    """Columns ``lag1..lagN`` of past values; rows without all of them go."""
    w = Window.partitionBy(*cell).orderBy("beat_idx")
    return beats.withColumns({f"lag{k}": F.lag(column, k).over(w) for k in range(1, lags + 1)}).where(F.col(f"lag{lags}").isNotNull())


def source_records(beats: DataFrame, row: str = "source_row", cell: list[str] = CELL, grid: DataFrame | None = None) -> DataFrame:
    """Per cell which rows of its source, counted from 1, its beats come from; cells of ``grid`` without beats have no_retained_rows."""
    n = F.count(F.lit(1))
    found = beats.groupBy(*cell).agg(n.alias("retained_rows"), F.format_string("1-based_data_rows_%d-%d;retained_rows=%d", F.min(row).cast("long"), F.max(row).cast("long"), n).alias("source_record"))
    if grid is None:
        return found
    found = grid.join(found, cell, "left")
    return found.withColumns({"retained_rows": F.coalesce("retained_rows", F.lit(0)), "source_record": F.coalesce("source_record", F.lit("no_retained_rows"))})
