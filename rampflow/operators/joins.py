"""Joins with a stated multiplicity, directions, grids and ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _once(df: DataFrame, on: list[str], side: str) -> DataFrame:
    """``df`` if its keys are unique; reading a row whose key occurs again raises an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*on))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{side}: a key occurs twice")).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    return left.join(_once(right, on, "right"), on, how)


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return _once(left, on, "left").join(_once(right, on, "right"), on, how)


def directions(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two rows for each: target and source of a to b, and of b to a. The target of a to b is b."""
    both = F.array(
        F.struct(F.lit(f"{a}_to_{b}").alias("direction"), F.col(b).alias("target"), F.col(a).alias("source")),
        F.struct(F.lit(f"{b}_to_{a}").alias("direction"), F.col(a).alias("target"), F.col(b).alias("source")),
    )
    return df.select("*", F.inline(both))


def dense_grid(df: DataFrame, *axes: DataFrame) -> DataFrame:
    """``df`` over the product of small axes, with nulls where it has no row."""
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(F.broadcast(axis))
    return grid.join(df, grid.columns, "left")


def ordinals(df: DataFrame, keys: list[str], base: int, step: int = 10) -> DataFrame:
    """Place of each distinct key in lexical order from 0, and the seed base + step * place. For tables of settings."""
    place = F.dense_rank().over(Window.orderBy(*keys)) - 1
    return df.select(*keys).distinct().withColumn("place", place).withColumn("seed", F.lit(base).cast("long") + F.lit(step) * F.col("place"))


def strict_cast(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Casts that fail on text that is no such value, whatever the session's ANSI setting."""

    def one(c: str, kind: str):
        bad = F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{c}: not {kind}: "), F.col(c))).cast(kind)).otherwise(F.col(c).try_cast(kind))

    return df.withColumns({c: one(c, k) for c, k in columns.items()})


def content_hash(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """SHA-256 over the rows in order, cells joined by commas and lines by LF. For tables of reporting size."""
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns])
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"])
    return df.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"), F.count(F.lit(1)).alias("n"))


def wanted(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows whose ``column`` is one of ``names``, with its place in that list; a short list, broadcast."""
    places = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{column}` string, place int")
    return df.join(F.broadcast(places), column)


def distinct_fits(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per ``keys`` of a table that repeats a fit for each direction; an error if a fit's rows differ in ``values``."""
    same = F.count_distinct(F.struct(*values)) <= 1
    return df.groupBy(*keys).agg(*[F.when(same, F.first(v)).otherwise(F.raise_error(F.lit("a fit has different rows")).cast(df.schema[v].dataType)).alias(v) for v in values])
