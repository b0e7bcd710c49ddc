"""Binary outcomes over phases: exact intervals, McNemar, Cochran."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.dist import binomial_two_sided, chi2_sf, clopper_pearson
from ..schema import CONTRASTS, PHASES
from .contrasts import wide
from .grouped import per_group


def prevalence(flags: DataFrame, flag: str, *keys: str) -> DataFrame:
    """successes, trials, share and exact 95 % interval; null flags are no trials."""
    counts = flags.groupBy(*keys).agg(F.count_if(F.col(flag)).alias("successes"), F.count(flag).alias("trials"))
    return per_group(counts, list(keys), ["successes"], ["successes", "trials"], lambda key, k, n: (int(k[0]), int(n[0]), k[0] / n[0] if n[0] else None, *clopper_pearson(int(k[0]), int(n[0]))), "successes long, trials long, share double, low double, high double")


def mcnemar(flags: DataFrame, flag: str, *keys: str) -> DataFrame:
    """Discordant pairs of each contrast of phases."""
    w = wide(flags.withColumn("_f", F.col(flag).cast("int")), "_f", *keys)
    parts = [F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in CONTRASTS]
    long = w.select(*keys, F.inline(F.array(*parts))).where("a is not null and b is not null")
    return long.groupBy(*keys, "contrast").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("first_only"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("second_only"))


def mcnemar_p(counts: DataFrame, *keys: str) -> DataFrame:
    return per_group(counts, [*keys, "contrast"], ["n"], ["first_only", "second_only"], lambda key, a, b: (int(a[0]), int(b[0]), binomial_two_sided(int(a[0]), int(a[0] + b[0]))), "first_only long, second_only long, p double")


def cochran(flags: DataFrame, flag: str, *keys: str, legacy_degenerate: bool = False) -> DataFrame:
    """Cochran's Q over the phases; without variation inside subjects it is not estimable (or 0 and 1 by the older rule).

    With three phases there are two degrees of freedom and p is exp(-Q / 2).
    """
    w = wide(flags.withColumn("_f", F.col(flag).cast("int")), "_f", *keys).dropna()
    row = sum((F.col(p) for p in PHASES[1:]), F.col(PHASES[0]))
    k = len(PHASES)
    columns = [F.sum(p) for p in PHASES]
    total = sum(columns[1:], columns[0])
    squares = sum((c * c for c in columns[1:]), columns[0] * columns[0])
    down = k * total - F.sum(row * row)
    out = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), ratio((k - 1) * (k * squares - total * total), F.when(down != 0, down)).alias("q"))
    if legacy_degenerate:
        out = out.withColumn("q", F.coalesce("q", F.lit(0.0)))
    p = F.exp(-F.col("q") / 2)
    status = F.when(F.col("q").isNotNull(), "estimable").otherwise("not_estimable")
    reason = F.when(F.col("q").isNotNull(), "NA").otherwise("no_within_participant_variation_across_phases")
    return out.withColumns({"p": p, "status": status, "reason": reason})


def chi_square_p(df: DataFrame, keys: list[str], statistic: str, degrees: str) -> DataFrame:
    return per_group(df, keys, [statistic], [statistic, degrees], lambda key, q, k: (float(q[0]), chi2_sf(float(q[0]), float(k[0]))), "statistic double, p double")
