"""Check tables: every check is a row (name, passed, detail); nothing raises until the table is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """One aggregate over ``df`` as a check."""
    return df.agg(passed.alias("passed"), detail.cast("string").alias("detail")).select(F.lit(name).alias("name"), F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("detail", F.lit("NA")).alias("detail"))


def all_checks(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require(checks: DataFrame) -> None:
    """Fail with the names of failed checks; the table has one row per check."""
    bad = [r["name"] for r in checks.where("not passed").collect()]
    if bad:
        raise AssertionError("failed: " + ", ".join(sorted(bad)))


def exactly_one(df: DataFrame, where: Column, name: str) -> DataFrame:
    n = F.count_if(where)
    return check(df, name, n == 1, n)


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return check(df.groupBy(*keys).count(), name, F.max("count") <= 1, F.max("count"))


def no_blanks(df: DataFrame, name: str) -> DataFrame:
    """No null, empty or padded cell in an all-text table."""
    bad = [F.count_if(F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`")) == "") | (F.trim(F.col(f"`{c}`")) != F.col(f"`{c}`"))) for c in df.columns]
    n = sum(bad[1:], bad[0])
    return check(df, name, n == 0, n)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Both tables have the same set of keys."""
    odd = a.select(*keys).exceptAll(b.select(*keys)).union(b.select(*keys).exceptAll(a.select(*keys)))
    return check(odd, name, F.count(F.lit(1)) == 0, F.count(F.lit(1)))


def close(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float, name: str) -> DataFrame:
    """Both tables have the same cells and their values agree within a tolerance; missing in both counts as equal."""
    x = a.select(*keys, F.lit(True).alias("_in_a"), *[F.col(v).alias(f"_a_{v}") for v in values])
    y = b.select(*keys, F.lit(True).alias("_in_b"), *[F.col(v).alias(f"_b_{v}") for v in values])
    pairs = [(F.col(f"_a_{v}"), F.col(f"_b_{v}")) for v in values]
    far = F.greatest(*[F.when(p.isNull() & q.isNull(), 0.0).otherwise(F.coalesce(F.abs(p - q), F.lit(float("inf")))) for p, q in pairs], F.lit(0.0))
    far = F.when(F.col("_in_a") & F.col("_in_b"), far).otherwise(float("inf"))  # a cell of one table alone is infinitely far
    return check(x.join(y, keys, "full_outer"), name, F.coalesce(F.max(far), F.lit(0.0)) <= tolerance, F.coalesce(F.max(far), F.lit(0.0)))


def matching(df: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    """Every value matches the whole pattern."""
    bad = F.count_if(~F.coalesce(F.col(column).rlike(f"^(?:{pattern})$"), F.lit(False)))
    return check(df, name, bad == 0, bad)


def forbidden(lines: DataFrame, patterns: dict[str, str], column: str = "value") -> DataFrame:
    """Hits of each forbidden pattern in a text table, as checks."""
    return all_checks(*[check(lines, n, F.count_if(F.col(column).rlike(p)) == 0, F.count_if(F.col(column).rlike(p))) for n, p in patterns.items()])


def anchors(values: DataFrame, known: DataFrame) -> DataFrame:
    """A check for each known result (name, value, tolerance) against ``values(name, value)``; a missing one fails."""
    j = known.select("name", F.col("value").alias("_want"), "tolerance").join(values.select("name", F.col("value").alias("_got")), "name", "left")
    far = F.abs(F.col("_got") - F.col("_want"))
    return j.select("name", F.coalesce(far <= F.col("tolerance"), F.lit(False)).alias("passed"), F.coalesce(far.cast("string"), F.lit("NA")).alias("detail"))


def table_shape(df: DataFrame, rows: int, columns: int, label: str) -> DataFrame:
    """Checks of an all-text table: number of rows and columns, no header twice, no blank or padded cell. Headers are known without a scan."""
    n, width, twice = F.count(F.lit(1)), len(df.columns), len(df.columns) - len(set(df.columns))
    safe = df.toDF(*[f"c{i}" for i in range(width)])
    return all_checks(
        check(safe, f"{label}/rows", n == rows, n),
        check(safe, f"{label}/columns", F.count(F.lit(1)).isNotNull() & F.lit(width == columns), F.max(F.lit(width))),
        check(safe, f"{label}/headers", F.count(F.lit(1)).isNotNull() & F.lit(twice == 0), F.max(F.lit(twice))),
        no_blanks(safe, f"{label}/blanks"),
    )


def family(df: DataFrame, p: str, size: int, eligible: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Checks of a family of tests: so many p values, and of exactly the eligible keys."""
    tested = df.where(F.col(p).isNotNull())
    return all_checks(check(tested, f"{name}/size", F.count(F.lit(1)) == size, F.count(F.lit(1))), same_keys(tested, eligible, keys, f"{name}/members"))
