"""A mixed model of one binary predictor and a random intercept a participant, from sums.

The likelihood needs of a participant only how many rows there are, how many of them have the predictor, and three
sums; and participants of equal number of rows enter it together. So rows are aggregated by participant and then by that
number, and the fit looks at a table of as many rows as there are different numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import per_group
from .kernels.regression import random_intercept_of_sums

TERMS = ("constant", "effect")
SUMS = ("people", "n", "x", "xx", "y", "yy", "xy", "each_yy", "each_xy")


def participant_sums(rows: DataFrame, y: str, x: str, *keys: str, who: str = "subject") -> DataFrame:
    """Per participant n, n_x (rows with the boolean ``x``), and sums of y less the mean of all rows of ``keys``; rows of null y go."""
    rows = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    centre = rows.groupBy(*keys).agg(F.avg(y).alias("centre"))
    # The key goes in front of the groups' own, so that a key with all rows is aggregated in every task first.
    d = F.col(y) - F.col("centre")
    g = rows.join(F.broadcast(centre), list(keys)).groupBy(*keys, who)
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(x).alias("n_x"),
        F.sum(d).alias("sum_y"),
        F.sum(F.when(F.col(x), d).otherwise(0.0)).alias("sum_xy"),
        F.sum(d * d).alias("sum_yy"),
        F.first("centre").alias("centre"),
    )


def eligibility(sums: DataFrame, *keys: str, least: int = 2) -> DataFrame:
    """Per key the participants and rows, the least number of rows of a participant with or without x, and whether that is enough."""
    low = F.min(F.least("n_x", F.col("n") - F.col("n_x")))
    return sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("participants"), F.sum("n").alias("rows"), low.alias("least_rows"), (low >= least).alias("eligible"))


def random_intercept(rows: DataFrame, y: str, x: str, *keys: str, who: str = "subject", least: int = 2) -> DataFrame:
    """REML fit of y = constant + effect x + participant + error for every key: a row a term, with the gate and the diagnostics.

    Where some participant has fewer than ``least`` rows with or without x nothing is fitted: status not_estimable, reason
    eligibility_gate_failed. A variance of participants of 1e-8 or less, or so small against the rest, is singular: the
    figures stay, as a record, and status is not_estimable too.
    """
    sums = participant_sums(rows, y, x, *keys, who=who)
    gate = eligibility(sums, *keys, least=least)
    each = sums.groupBy(*keys, "n").agg(
        F.count(F.lit(1)).alias("people"),
        F.sum("n_x").alias("x"),
        F.sum(F.col("n_x") * F.col("n_x")).alias("xx"),
        F.sum("sum_y").alias("y"),
        F.sum(F.col("sum_y") * F.col("sum_y")).alias("yy"),
        F.sum(F.col("n_x") * F.col("sum_y")).alias("xy"),
        F.sum("sum_yy").alias("each_yy"),
        F.sum("sum_xy").alias("each_xy"),
        F.first("centre").alias("centre"),
    )
    figures = "term string, b double, se double, z double, p double, low double, high double, group_variance double, residual_variance double, variance_ratio double, log_likelihood double, condition double, singular boolean"

    def kernel(key, centre, *table):
        return random_intercept_of_sums(dict(zip(SUMS, table, strict=True)), float(centre[0]), TERMS)

    fitted = each.join(gate.where("eligible").select(*keys), list(keys), "left_semi")
    made = per_group(fitted, list(keys), ["n"], ["centre", *SUMS], kernel, figures)
    reason = F.when(~F.col("eligible"), "eligibility_gate_failed").when(F.coalesce("singular", F.lit(True)), "nonconvergence_or_singular_random_intercept").otherwise("NA")
    out = gate.join(made, list(keys), "left").withColumn("reason", reason)
    return out.withColumn("status", F.when(F.col("reason") == "NA", "estimable").otherwise("not_estimable"))


def residuals(rows: DataFrame, fit: DataFrame, y: str, x: str, *keys: str, who: str = "subject") -> DataFrame:
    """``rows`` with fitted (the participant's share too) and residual, of estimable fits; the share is shrunk by n."""
    wide = fit.where("status = 'estimable'").groupBy(*keys).agg(F.max(F.when(F.col("term") == TERMS[0], F.col("b"))).alias("_a"), F.max(F.when(F.col("term") == TERMS[1], F.col("b"))).alias("_b"), F.max("variance_ratio").alias("_ratio"))
    rows = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).join(F.broadcast(wide), list(keys))
    rows = rows.withColumn("_line", F.col("_a") + F.when(F.col(x), F.col("_b")).otherwise(0.0))
    own = rows.groupBy(*keys, who).agg(F.sum(F.col(y) - F.col("_line")).alias("_e"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(own, [*keys, who])
    fitted = F.col("_line") + F.col("_ratio") / (1 + F.col("_ratio") * F.col("_n")) * F.col("_e")
    return rows.withColumns({"fitted": fitted, "residual": F.col(y) - fitted}).drop("_a", "_b", "_ratio", "_line", "_e", "_n")


def residual_shape(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean, SD, bias-corrected skewness and excess kurtosis of residuals, in one aggregation."""
    n, e = F.count("residual"), "residual"
    g = rows.groupBy(*keys).agg(n.alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("sd"), F.skewness(e).alias("_g1"), F.kurtosis(e).alias("_g2"))
    k = F.col("n")
    skew = F.when(k > 2, F.sqrt(k * (k - 1)) / (k - 2) * F.col("_g1"))
    kurt = F.when(k > 3, (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.col("_g2") + 6))
    return g.withColumns({"skewness": skew, "excess_kurtosis": kurt}).drop("_g1", "_g2")
