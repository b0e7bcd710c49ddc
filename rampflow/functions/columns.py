"""Column builders with one meaning in every query: finite values, safe ratios, seeds, identifiers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite. The NaN test is first: Spark holds NaN greater than all numbers."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def known(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(finite(x), x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where a side is constant (``corr`` would raise there)."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def slope(y: str, x: str) -> Column:
    """Least-squares slope of y on x; null where x is constant."""
    return ratio(F.covar_pop(x, y), F.var_pop(x))


def cohens_dz(d: str, zero_sd: float | None = None) -> Column:
    """Mean over sample SD; a zero SD gives null, or ``zero_sd`` where all differences are 0."""
    plain = ratio(F.avg(d), F.stddev_samp(d))
    if zero_sd is None:
        return plain
    return F.when((F.stddev_samp(d) == 0) & (F.avg(d) == 0), F.lit(zero_sd)).otherwise(plain)


def average_rank(x: str, *keys: str) -> Column:
    """Rank from 1 with ties averaged, within keys."""
    by = Window.partitionBy(*keys)
    return F.rank().over(by.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0


def benjamini_hochberg(p: str, *family: str) -> Column:
    """Step-up adjusted p values within a family; null p values stay null and don't count."""
    by = Window.partitionBy(*family)
    m = F.count(p).over(by)
    place = F.row_number().over(by.orderBy(F.col(p).asc_nulls_last()))
    raw = F.col(p) * m / place
    # The running minimum from the largest p down.
    least = F.min("_raw").over(by.orderBy(F.col(p).desc_nulls_first(), F.col("_place").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return raw, place, F.when(F.col(p).isNotNull(), F.least(least, F.lit(1.0)))


def with_bh(df, p: str, out: str, *family: str):
    """``df`` with BH-adjusted p values in ``out``, within families by windows; the whole table as one family by a distributed scan."""
    if not family:
        from ..operators.scans import step_up

        return step_up(df, p, out)
    raw, place, q = benjamini_hochberg(p, *family)
    return df.withColumn("_raw", raw).withColumn("_place", place).withColumn(out, q).drop("_raw", "_place")


def stable_seed(base: int, *keys: Column) -> Column:
    """(base + crc32 of the keys joined by |) modulo 2**32 - 1."""
    return F.pmod(F.lit(base).cast("long") + F.crc32(F.encode(F.concat_ws("|", *keys), "utf-8")), F.lit(4294967295).cast("long"))


def _texts(rows: pd.Series) -> pd.Series:
    return rows.map(lambda row: None if row is None else "|".join(f"{v:.15g}" for v in row if v is not None))


def text_array(x: Column) -> Column:
    """Numbers with 15 significant digits, joined by |, nulls left out.

    Rounded from the binary value as in C: Java's formatter rounds the shortest decimal, which is off in the last digit for
    one number in forty.
    """
    return F.pandas_udf(_texts, "string")(x.cast("array<double>"))
