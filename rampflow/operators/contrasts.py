"""Paired contrasts of phases: pivots, signs, effect sizes, ranks, omission, agreement, correlation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import average_rank, cohens_dz, pearson, ratio, with_bh
from ..functions.dist import signed_rank, t_sf2
from ..schema import CONTRASTS, PHASES
from .grouped import per_group, per_row
from .kernels.bootstrap import STATISTICS, bca, omitted_correlation, omitted_spearman
from .kernels.slopes import median_slope


def wide(df: DataFrame, value: str, *keys: str, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """One column per phase. A cell that occurs twice raises an error, as a pivot would otherwise pick one."""
    once = F.when(F.count(F.lit(1)) <= 1, F.first(value)).otherwise(F.raise_error(F.lit("a cell occurs twice")).cast("double"))
    return df.groupBy(*keys, "subject").pivot("phase", list(phases)).agg(once.alias("v"))


def differences(df: DataFrame, value: str, *keys: str, contrasts=CONTRASTS) -> DataFrame:
    """Complete pairs of each contrast in long form: contrast, first, second, d. Contrasts may name phases or sub-phases."""
    w = wide(df, value, *keys, phases=tuple(dict.fromkeys(p for c in contrasts for p in c)))
    parts = [F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.col(a).alias("first"), F.col(b).alias("second")) for a, b in contrasts]
    long = w.select(*keys, "subject", F.inline(F.array(*parts)))
    return long.where("first is not null and second is not null").withColumn("d", F.col("first") - F.col("second"))


def summary(pairs: DataFrame, *keys: str) -> DataFrame:
    """n, means, mean and median difference, dz and signs of each group of pairs."""
    return pairs.groupBy(*keys).agg(
        F.count("d").alias("n"),
        F.avg("first").alias("mean_first"),
        F.avg("second").alias("mean_second"),
        F.avg("d").alias("mean_difference"),
        F.median("d").alias("median_difference"),
        cohens_dz("d").alias("dz"),
        F.count_if(F.col("d") < 0).alias("n_negative"),
        F.count_if(F.col("d") > 0).alias("n_positive"),
        F.count_if(F.col("d") == 0).alias("n_zero"),
    )


def signed_ranks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Wilcoxon's rank sums without zeros, ties averaged, and W, by window functions."""
    rows = pairs.where("d <> 0").withColumn("_a", F.abs("d"))
    rows = rows.withColumn("_rank", average_rank("_a", *keys))
    up, down = F.sum(F.when(F.col("d") > 0, F.col("_rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("_rank")).otherwise(0.0))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nonzero"), up.alias("w_plus"), down.alias("w_minus"), F.least(up, down).alias("w"))


def signed_rank_p(pairs: DataFrame, *keys: str) -> DataFrame:
    return per_group(pairs, list(keys), ["subject"], ["d"], lambda key, d: signed_rank(d), "w double, p double, p_method string")


def intervals(pairs: DataFrame, *keys: str, times: int = 10_000, seed: int = 20260805, statistics: tuple[str, ...] = tuple(STATISTICS)) -> DataFrame:
    """BCa intervals, subjects in order of their names; a task for every group and statistic.

    Statistic i of a group is drawn with the group's seed + i. That is ``seed`` + 10 times the place of
    its contrast, or what a column ``seed`` of ``pairs`` says (one value a group, as of joins.ordinals).
    """
    place = {f"{a}-{b}": i for i, (a, b) in enumerate(CONTRASTS)}
    own = ["seed"] if "seed" in pairs.columns else []
    packed = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("subject", "d", *own))).alias("_rows"))
    values = [F.transform("_rows", lambda r: r["d"].cast("double")).alias("_d"), (F.transform("_rows", lambda r: r["seed"].cast("double")) if own else F.array().cast("array<double>")).alias("_seed")]
    jobs = packed.select(*keys, *values, F.posexplode(F.array(*map(F.lit, statistics))).alias("_i", "statistic"))
    jobs = jobs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism, *keys, "statistic")

    def kernel(key, d, own, i):
        *group, statistic = key
        base = int(own[0]) if len(own) else seed + 10 * next((place[k] for k in group if k in place), 0)
        return bca(d, statistic, times, base + int(i[0]))

    return per_row(jobs.select(*keys, "statistic", "_d", "_seed", F.array("_i")), [*keys, "statistic"], kernel, "estimate double, low double, high double")


def leave_one_out(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean, median and dz with each subject left out, in one pass of window functions and without a join.

    Sums are of centred values, so nothing cancels. The median of the others lies at one or two of three
    places of the whole order, depending on whether the omitted value comes before them.
    """
    whole = Window.partitionBy(*keys)
    rows = pairs.where("d is not null").withColumns({"_n": F.count(F.lit(1)).over(whole), "_mean": F.avg("d").over(whole), "_r": F.row_number().over(whole.orderBy("d", "subject"))})
    rows = rows.withColumn("_c", F.col("d") - F.col("_mean"))
    m = F.col("_n") - 1
    rows = rows.withColumns({"_s": F.sum("_c").over(whole) - F.col("_c"), "_q": F.sum(F.col("_c") * F.col("_c")).over(whole) - F.col("_c") * F.col("_c"), "_k": F.floor((m + 1) / 2)})
    at = lambda p: F.max(F.when(F.col("_r") == p, F.col("d"))).over(whole)
    rows = rows.withColumns({"_a": at(F.col("_k")), "_b": at(F.col("_k") + 1), "_e": at(F.col("_k") + 2)})
    low = F.when(F.col("_r") > F.col("_k"), F.col("_a")).otherwise(F.col("_b"))
    high = F.when(F.col("_r") > F.col("_k") + 1, F.col("_b")).otherwise(F.col("_e"))
    mean = F.col("_mean") + ratio(F.col("_s"), m)
    sd = F.sqrt(F.greatest(F.lit(0.0), ratio(F.col("_q") - ratio(F.col("_s") * F.col("_s"), m), m - 1)))
    median = F.when(m % 2 == 1, low).otherwise((low + high) / 2)
    return rows.where("_n > 1").select(*keys, F.col("subject").alias("omitted"), m.alias("n"), mean.alias("mean"), median.alias("median"), F.when(m > 1, ratio(mean, sd)).alias("dz"))


def jackknife_means(pairs: DataFrame, *keys: str) -> DataFrame:
    """The same for means alone without a join: (sum - x) / (n - 1)."""
    w = Window.partitionBy(*keys)
    return pairs.select(*keys, F.col("subject").alias("omitted"), ratio(F.sum("d").over(w) - F.col("d"), F.count("d").over(w) - 1).alias("mean"))


def bland_altman(a: DataFrame, b: DataFrame, value: str, on: list[str]) -> DataFrame:
    """Agreement of two methods: n, bias, SD, limits, ratio of means, share of equal signs."""
    j = a.select(*on, F.col(value).alias("x")).join(b.select(*on, F.col(value).alias("y")), on).where("x is not null and y is not null")
    out = j.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("x") - F.col("y")).alias("bias"),
        F.stddev_samp(F.col("x") - F.col("y")).alias("sd"),
        ratio(F.avg("x"), F.avg("y")).alias("ratio_of_means"),
        ratio(F.count_if(F.signum("x") == F.signum("y")), F.count(F.lit(1))).alias("sign_agreement"),
    )
    return out.withColumns({"loa_low": F.col("bias") - 1.96 * F.col("sd"), "loa_high": F.col("bias") + 1.96 * F.col("sd")})


def pearson_ci(df: DataFrame, x: str, y: str, *keys: str, z: float = 1.959963984540054) -> DataFrame:
    """r and its Fisher interval; null ends under four pairs."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("r"))
    fine = (F.col("n") > 3) & (F.abs("r") < 1)
    end = lambda sign: F.when(fine, F.tanh(F.atanh("r") + sign * z / F.sqrt(F.col("n") - 3)))
    return r.withColumns({"low": end(-1), "high": end(1)})


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_x": average_rank(x, *keys), "_y": average_rank(y, *keys)})
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("rho"))


def correlations(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """n, Spearman's rho and Pearson's r of complete pairs with their p values (Student's t); null without spread, p under 3 pairs."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_x": average_rank(x, *keys), "_y": average_rank(y, *keys)})
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_x", "_y").alias("rho"), pearson(x, y).alias("r"))

    def kernel(key, n, *both):
        def tail(c: float) -> float:
            if n[0] < 3 or not math.isfinite(c):
                return math.nan
            return t_sf2(abs(c) * math.sqrt((n[0] - 2) / (1 - c * c)), n[0] - 2) if abs(c) < 1 else 0.0

        tails = [tail(c[0]) for c in both]
        return int(n[0]), float(both[0][0]), float(both[1][0]), *tails

    return per_group(out, list(keys), ["n"], ["n", "rho", "r"], kernel, "n long, rho double, r double, rho_p double, r_p double")


def leave_one_out_correlations(df: DataFrame, x: str, y: str, *keys: str, on: str = "subject") -> DataFrame:
    """rho and r of each group with each participant left out, from sums and counts; a group is the participants of one study, one array."""

    def kernel(key, who, a, b):
        keep = np.isfinite(a) & np.isfinite(b)
        who, a, b = who[keep], a[keep], b[keep]
        rho, r = omitted_spearman(a, b), omitted_correlation(a, b)
        return [(i, len(a) - 1, *both) for i, *both in zip(who.tolist(), rho.tolist(), r.tolist(), strict=True)]

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(on)) - 1)
    found = per_group(rows, list(keys), ["_at"], ["_at", x, y], kernel, "_at double, n long, rho double, r double")
    return found.join(rows.select(*keys, F.col("_at").cast("double").alias("_at"), F.col(on).alias("omitted")), [*keys, "_at"]).drop("_at")


def partial_spearman(df: DataFrame, x: str, y: str, z: str, *keys: str) -> DataFrame:
    """Spearman of what is left of the ranks of x and y once the ranks of z are taken out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull())
    rows = rows.withColumns({"_x": average_rank(x, *keys), "_y": average_rank(y, *keys), "_z": average_rank(z, *keys)})
    w = Window.partitionBy(*keys)
    rest = lambda v: F.col(v) - F.regr_intercept(v, "_z").over(w) - F.regr_slope(v, "_z").over(w) * F.col("_z")
    rows = rows.withColumns({"_rx": F.round(rest("_x"), 9), "_ry": F.round(rest("_y"), 9)})
    return spearman(rows.select(*keys, "_rx", "_ry"), "_rx", "_ry", *keys).withColumnRenamed("rho", "partial_rho")


def theil_sen(df: DataFrame, x: str, y: str, *keys: str, on: str = "subject") -> DataFrame:
    """Median of pairwise slopes by selection, n log n in a group's rows; groups without two different x have no row."""
    found = per_group(df, list(keys), [on], [x, y], lambda key, a, b: median_slope(a, b), "n_pairs long, slope double")
    return found.where("n_pairs > 0")


def classify(df: DataFrame, low: str, high: str, n: str, least: int = 15) -> DataFrame:
    """increase, decrease, no clear change or inconclusive, from an interval and the number of pairs."""
    c = F.when(F.col(n) < least, "inconclusive").when(F.col(low) > 0, "increase").when(F.col(high) < 0, "decrease").otherwise("no_clear_change")
    return df.withColumn("class", c)


__all__ = ["bland_altman", "classify", "correlations", "differences", "intervals", "jackknife_means", "leave_one_out", "leave_one_out_correlations", "partial_spearman", "pearson_ci", "signed_rank_p", "signed_ranks", "spearman", "summary", "theil_sen", "wide", "with_bh"]
