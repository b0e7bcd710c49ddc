"""Ordered scans over a whole table: places and step-up minima, without a window that gathers all rows in one task.

Rows are dealt into ranges of the ordering value by cuts from an approximate quantile sketch. Ranges are sorted
each for itself, and what crosses them is one carry a range (and family).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ranged(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``_range``: the number of cuts below the value; equal values share a range, nulls come after all others."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(by, [i / parts for i in range(1, parts)] or [0.5], 20 * parts).alias("_cuts"))
    below = F.size(F.filter(F.col("_cuts"), lambda c: c < F.col(by)))
    return df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.when(F.col(by).isNull(), parts + 1).otherwise(below)).drop("_cuts")


def _same(left: DataFrame, right: DataFrame, names: list[str]):
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return left.alias("l").join(right.alias("r"), on, "left")


def places(df: DataFrame, by: str, *ties: str, out: str = "place") -> DataFrame:
    """``df`` with the row's place from 1 in the order of ``by`` (nulls last) and ``ties``. Rows of equal ``by`` are one task's."""
    rows = _ranged(df, by)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    carry = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(by).asc_nulls_last(), *ties))
    found = rows.withColumn(out, nth).join(F.broadcast(carry), "_range")
    return found.withColumn(out, (F.col(out) + F.col("_before")).cast("int")).select(*df.columns, out)


def step_up(df: DataFrame, p: str, out: str, *family: str) -> DataFrame:
    """``df`` with Benjamini-Hochberg q values; null p values stay null and don't count.

    The q of a value depends on the value and the numbers of smaller ones alone, so rows are first counted by value: however many
    share one, it is one row of the scan. A running count up and a running minimum down make q, which rows look up by value.
    """
    keys = list(family)
    each = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count(F.lit(1)).alias("_n"))
    rows = _ranged(each, p)
    spans = rows.groupBy(*keys, "_range").agg(F.sum("_n").alias("_n"))
    whole, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_m"))
    rows = _same(rows, spans, [*keys, "_range"]).select("l.*", "r._before", "r._m")
    inside = Window.partitionBy(*keys, "_range")
    k = F.sum("_n").over(inside.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    rows = rows.withColumn("_raw", F.col(p) * F.col("_m") / k)
    after = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy(*keys, "_range").agg(F.min("_raw").alias("_least")).select(*keys, "_range", F.min("_least").over(after).alias("_after"))
    rows = _same(rows, least, [*keys, "_range"]).select("l.*", "r._after")
    down = F.min("_raw").over(inside.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    q = rows.select(*keys, p, F.least(down, F.coalesce("_after", F.lit(1.0)), F.lit(1.0)).alias(out))
    on = F.col(f"l.{p}") == F.col(f"r.{p}")
    for n in keys:
        on = on & F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}"))
    return df.alias("l").join(q.alias("r"), on, "left").select("l.*", f"r.{out}")


def runs(df: DataFrame, key: str, by: str, out: str = "run") -> DataFrame:
    """``df(key, by)`` of distinct whole numbers with the first number of the run of consecutive ones that each is in.

    A run begins where the number before is missing, which a join tells; a running maximum of beginnings inside ranges, and of
    earlier ranges, is a row's own.
    """
    before = df.select(F.col(key).alias("_k"), (F.col(by) + 1).alias("_next"))
    first = df.join(before, F.col(key).eqNullSafe(F.col("_k")) & (F.col(by) == F.col("_next")), "left")
    rows = _ranged(first.select(key, by, F.when(F.col("_next").isNull(), F.col(by)).alias("_first")), by)
    spans = rows.groupBy(key, "_range").agg(F.max("_first").alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, "_range", F.max("_last").over(earlier).alias("_carry"))
    inside = Window.partitionBy(key, "_range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    rows = _same(rows.withColumn("_own", F.max("_first").over(inside)), spans, [key, "_range"])
    return rows.select(*[f"l.{c}" for c in (key, by)], F.coalesce("l._own", "r._carry").alias(out))
