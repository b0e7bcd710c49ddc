"""Resampling in many tasks: random streams by counter, so that a draw does not depend on who makes it.

A group's draws come in units of fixed size. A unit's stream is the group's key and the unit's number as the counter of a
counter-based generator; any task can make any unit, a lost one is made again alike, and the result is the same however
units are dealt. A group's arrays are the participants of one study; its draws, at most ``times`` numbers, meet
in one row for the interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import per_row
from .kernels import bootstrap
from .kernels.slopes import Resampled

#: Draws of one unit.
UNIT = 500
#: Most partitions a core over which units are dealt.
JOBS = 16


@dataclass(frozen=True)
class Analysis:
    """What is drawn how often: pearson, spearman or theil_sen of paired resamples, or permutation (of Spearman's rho)."""

    name: str
    times: int


def stream(seed: int, name: str, key: tuple, unit: int) -> np.random.Generator:
    words = np.random.SeedSequence([seed, *map(ord, "/".join([name, *map(str, key)]))]).generate_state(2, np.uint64)
    return np.random.Generator(np.random.Philox(key=words, counter=[0, 0, 0, unit]))


def _unit(name: str, rng: np.random.Generator, x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    sizes = bootstrap.blocks(count, len(x))
    if name == "permutation":  # one number: how many permutations are as far from 0
        a, b = bootstrap.ranks(x), bootstrap.ranks(y)
        if len(b) > bootstrap.PAIRWISE:
            return np.array([bootstrap.as_far(a, b, count, rng)], float)
        known, far = abs(float(bootstrap.correlation(a, b))) - 1e-15, 0
        for k in sizes:
            mixed = b[np.argsort(rng.random((k, len(b))), axis=1)]
            far += int((np.abs(bootstrap.correlation(np.broadcast_to(a, mixed.shape), mixed)) >= known).sum())
        return np.array([far], float)
    n = len(x)
    draws = (rng.integers(0, n, (k, n)) for k in sizes)
    if name == "theil_sen" and n > bootstrap.PAIRWISE:
        return Resampled(x, y)(draws)
    if name == "spearman":
        x, y = bootstrap.places(x), bootstrap.places(y)
    return np.concatenate([bootstrap.PAIRED[name](x, y, at) for at in draws])


def paired(df: DataFrame, keys: list[str], order: str, x: str, y: str, analyses: tuple[Analysis, ...], seed: int, level: float = 0.95) -> DataFrame:
    """(keys, analysis, estimate, low, high, p) of paired columns of every group; rows with a null or NaN are left out.

    Correlations have a bias-corrected accelerated interval and no p, Theil-Sen a percentile interval, the permutation test
    a two-sided p and no interval. Under four pairs, or without spread, there are estimates at most.
    """
    spark = df.sparkSession
    fine = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    rows = fine.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_rows"))
    packed = rows.select(*keys, F.transform("_rows", lambda r: r["x"]).alias("_x"), F.transform("_rows", lambda r: r["y"]).alias("_y"))
    times = {a.name: a.times for a in analyses}
    wanted = F.array(*[F.struct(F.lit(a.name).alias("analysis"), F.lit(-(-a.times // UNIT)).alias("units")) for a in analyses])
    jobs = packed.select(*keys, "_x", "_y", F.inline(wanted)).withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    # Units differ much in time: so many partitions that few of them share one.
    cores, units = spark.sparkContext.defaultParallelism, sum(-(-a.times // UNIT) for a in analyses)
    jobs = jobs.repartition(max(2 * cores, min(JOBS * cores, units)), *keys, "analysis", "unit")

    def draw(key, a, b):
        *group, name, unit = key
        if len(a) < 4 or not (a.std() > 0 and b.std() > 0):
            return ([],)
        count = min(UNIT, times[name] - int(unit) * UNIT)
        return (_unit(name, stream(seed, name, tuple(group), int(unit)), a, b, count).tolist(),)

    drawn = per_row(jobs.select(*keys, "analysis", "unit", "_x", "_y"), [*keys, "analysis", "unit"], draw, "found array<double>")
    # Units in order, so that sums of draws are the same too.
    drawn = drawn.groupBy(*keys, "analysis").agg(F.sort_array(F.collect_list(F.struct("unit", "found"))).alias("_units"))
    drawn = drawn.select(*keys, "analysis", F.flatten(F.transform("_units", lambda u: u["found"])).alias("_found"))

    def close(key, found, a, b):
        name = key[-1]
        if name == "permutation":
            rho = float(bootstrap.correlation(bootstrap.ranks(a), bootstrap.ranks(b))) if len(a) > 1 else None
            return rho, None, None, (1 + found.sum()) / (1 + times[name]) if len(found) else None
        estimate = float(bootstrap.PAIRED[name](a, b, np.arange(len(a))[None])[0]) if len(a) > 1 else None
        if not len(found):
            return estimate, None, None, None
        if name == "theil_sen":
            found = found[np.isfinite(found)]
            ends = np.quantile(found, ((1 - level) / 2, (1 + level) / 2)) if len(found) else (None, None)
        else:
            ends = bootstrap.interval(estimate, found, bootstrap.OMITTED[name](a, b), level, 1e-15)
        return estimate, *ends, None

    met = drawn.join(packed, keys).select(*keys, "analysis", "_found", "_x", "_y")
    return per_row(met, [*keys, "analysis"], close, "estimate double, low double, high double, p double")
