"""Verdicts from result tables: validation of methods, adoption, directions, temporal patterns, association.

Every rule is an aggregate over a table of results and a chain of conditions; nothing is looped or collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest pairs for inference, level, what counts as a small effect.
LEAST_PAIRS, ALPHA, SMALL = 15, 0.05, 0.50
#: Fixed values of the gate: most false positives, least right directions, most failures, least with the stronger of two.
MOST_FALSE, LEAST_RIGHT, MOST_FAILED, LEAST_STRONGER = 0.10, 0.80, 0.05, 0.65


def _share(c: Column) -> Column:
    return F.avg(c.cast("int"))


def validation_summary(rows: DataFrame) -> DataFrame:
    """Per method, scenario and noise of rows(method, scenario, noise, forward, reverse, forward_hit, reverse_hit).

    A strength is null where an estimate failed; a hit is a shift test below the level. false positives count
    only without coupling; a replicate with a missing strength has no right direction.
    """
    by = rows.groupBy("method", "scenario", "noise").agg(
        F.count(F.lit(1)).alias("replicates"),
        (F.count("forward") + F.count("reverse")).alias("finite"),
        F.avg("forward").alias("mean_forward"),
        F.avg("reverse").alias("mean_reverse"),
        _share(F.coalesce(F.col("forward") > F.col("reverse"), F.lit(False))).alias("right_share"),
        _share(F.coalesce(F.col("forward_hit"), F.lit(False))).alias("_f"),
        _share(F.coalesce(F.col("reverse_hit"), F.lit(False))).alias("_r"),
    )
    alone = F.col("scenario") == "uncoupled_linear"
    by = by.withColumns({"failure_rate": 1 - F.col("finite") / (2 * F.col("replicates")), "forward_false": F.when(alone, F.col("_f")), "reverse_false": F.when(alone, F.col("_r"))})
    return by.drop("_f", "_r")


def method_gate(summary: DataFrame) -> DataFrame:
    """Per method whether it is validated: false positives, directions at moderate noise, failures, the stronger of two."""
    at = lambda scenario: F.max(F.when((F.col("scenario") == scenario) & (F.col("noise") == "moderate"), F.col("right_share")))
    out = summary.groupBy("method").agg(
        (F.greatest(F.max("forward_false"), F.max("reverse_false")) <= MOST_FALSE).alias("false_positives_pass"),
        at("unidirectional_linear_X_to_Y").alias("linear_share"),
        at("unidirectional_nonlinear_X_to_Y").alias("nonlinear_share"),
        (F.max("failure_rate") <= MOST_FAILED).alias("failures_pass"),
        at("bidirectional_X_to_Y_stronger").alias("stronger_share"),
    )
    out = out.withColumns({"direction_pass": F.least("linear_share", "nonlinear_share") >= LEAST_RIGHT, "stronger_pass": F.col("stronger_share") >= LEAST_STRONGER})
    fine = F.coalesce(F.col("false_positives_pass") & F.col("direction_pass") & F.col("failures_pass") & F.col("stronger_pass"), F.lit(False))
    return out.withColumn("status", F.when(fine, "VALIDATED").otherwise("METHOD_NOT_VALIDATED"))


def reusable(rows: DataFrame, expected_rows: int, digest: Column, expected_digest: str | None) -> DataFrame:
    """Whether stored validation rows can stand for a new run: as many as asked for, complete keys, and the digest known."""
    keys = ["method", "scenario", "noise", "replicate"]
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*keys).alias("jobs"), digest.alias("digest"))
    same = F.lit(True) if expected_digest is None else F.col("digest") == expected_digest
    return out.withColumn("reusable", F.coalesce((F.col("n") == expected_rows) & (F.col("jobs") == expected_rows) & same, F.lit(False)))


def stability(effects: DataFrame, setting: str = "setting", primary: str = "primary") -> DataFrame:
    """(method, direction, stable_share): share of the other settings with an effect whose sign is the primary setting's."""
    other = effects.where((F.col(setting) != primary) & F.col("mean_difference").isNotNull())
    return other.groupBy("method", "direction").agg(_share(F.col("agrees")).alias("stable_share"))


def outcomes(contrasts: DataFrame, stable: DataFrame, free: tuple[str, ...] = ("SSC",)) -> DataFrame:
    """Of the primary contrast's rows (method, direction, n, low, high, p, q, dz): each rule, and whether all hold.

    Methods of ``free`` have no settings to agree. A null figure fails its rule.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = contrasts.where("contrast = 'Stim-Pre'").join(stable, ["method", "direction"], "left")
    out = out.withColumns(
        {
            "q_below": yes(F.col("q") < ALPHA),
            "interval_excludes_zero": yes((F.col("low") > 0) | (F.col("high") < 0)),
            "enough_pairs": yes(F.col("n") >= LEAST_PAIRS),
            "majority_agrees": F.col("method").isin(*free) | yes(F.col("stable_share") > 0.5),
        }
    )
    return out.withColumn("robust", F.col("q_below") & F.col("interval_excludes_zero") & F.col("enough_pairs") & F.col("majority_agrees"))


def adoption(gate: DataFrame, judged: DataFrame, prevalence: DataFrame) -> DataFrame:
    """One row: the verdict and the conditions it rests on.

    ``gate(method, status)``, ``judged`` as of outcomes, ``prevalence(mcnemar_p, cochran_p)``. No inference
    without a validated method and an outcome of enough pairs; a robust outcome is reported as exploratory; a brief null
    needs every sign of one; all else is inconclusive.
    """
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    every = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))
    a = gate.agg(some(F.col("status") == "VALIDATED").alias("any_validated"))
    b = judged.agg(
        some(F.col("enough_pairs")).alias("any_enough"),
        some(F.col("robust")).alias("any_robust"),
        some(F.col("p") < ALPHA).alias("nominal"),
        some(F.col("n") < LEAST_PAIRS).alias("any_few"),
        every(F.col("q") >= ALPHA).alias("all_q_null"),
        every((F.col("low") <= 0) & (F.col("high") >= 0)).alias("all_intervals_hold_zero"),
        every(F.abs("dz") < SMALL).alias("all_small"),
        some(F.col("stable_share") < 0.75).alias("unstable"),
    )
    c = prevalence.agg((some(F.col("mcnemar_p") < ALPHA) | some(F.col("cochran_p") < ALPHA)).alias("prevalence_shift"))
    out = a.crossJoin(b).crossJoin(c)  # one row each
    null = F.col("all_q_null") & F.col("all_intervals_hold_zero") & ~F.col("nominal") & ~F.col("any_few") & (F.col("all_small") | F.col("unstable")) & ~F.col("prevalence_shift")
    # The names of the verdicts.
    verdict = (
        F.when(~F.col("any_validated") | ~F.col("any_enough"), "DO_NOT_REPORT_REAL_DATA_INFERENCE")
        .when(F.col("any_robust"), "SI_EXPLORATORY_NON_NULL")
        .when(null, "SI_BRIEF_NULL_SENSITIVITY")
        .otherwise("RESPONSE_ONLY_INCONCLUSIVE")
    )
    return out.withColumn("verdict", verdict)


def branch_direction(contrasts: DataFrame) -> DataFrame:
    """One row: how the two text-matched branches answer the reference branch, from rows (branch, n, mean_difference)."""
    one = lambda name, c: F.max(F.when(F.col("branch") == name, F.col(c)))
    row = contrasts.agg(*[one(n, c).alias(f"{n}_{c}") for n in ("A0_MAX", "A1_MAX", "REF") for c in ("n", "mean_difference")])
    a, b, ref = (F.col(f"{n}_mean_difference") for n in ("A0_MAX", "A1_MAX", "REF"))
    few = F.coalesce(F.least("A0_MAX_n", "A1_MAX_n"), F.lit(0)) < LEAST_PAIRS
    few = few | F.col("A0_MAX_n").isNull() | F.col("A1_MAX_n").isNull()
    ratio = F.try_divide(F.abs((a + b) / 2), F.abs(ref))
    # The names of the classes.
    found = (
        F.when(few, "DIRECTION_INCONCLUSIVE_DUE_TO_EVALUABILITY")
        .when(a * b < 0, "METHOD_BRANCHES_DISCORDANT")
        .when((a > 0) & (b > 0), "DIRECTION_REVERSED_POSITIVE")
        .when((a < 0) & (b < 0) & (ratio < 0.50), "DIRECTION_ATTENUATED_BUT_NEGATIVE")
        .when((a < 0) & (b < 0), "DIRECTION_PRESERVED_NEGATIVE")
        .otherwise("DIRECTION_INCONCLUSIVE_DUE_TO_EVALUABILITY")
    )
    return row.withColumn("class", found)


def temporal_pattern(response: DataFrame) -> DataFrame:
    """One row: early against late stimulation, from rows (dimension, contrast, n, mean_difference).

    Dimensions are REF, A0_MAX and A1_MAX gains, sbp and hr; contrasts Stim_early-Pre_late and Stim_late-Pre_late.
    """
    early, late = (F.col("contrast") == f"Stim_{x}-Pre_late" for x in ("early", "late"))
    gain, d = F.col("dimension").isin("REF", "A0_MAX", "A1_MAX"), F.col("mean_difference")
    of = lambda when, which: F.max(F.when(when & (F.col("dimension") == which), d))
    kinds = lambda when: F.count_distinct(F.when(gain & when, F.signum(d)))
    below = lambda when: F.coalesce(F.bool_and(F.when(gain & when, d < 0)), F.lit(False))
    row = response.agg(
        F.min(F.when(gain & (early | late), F.col("n"))).alias("least_n"),
        F.count_if(gain & (early | late) & d.isNotNull()).alias("known"),
        F.greatest(kinds(early), kinds(late)).alias("signs"),
        below(early).alias("early_lower"),
        below(late).alias("late_lower"),
        F.coalesce(F.bool_and(F.when(gain & late, d > 0)), F.lit(False)).alias("late_higher"),
        (of(early, "sbp") > 0).alias("early_pressor"),
        (of(late, "sbp") > 0).alias("late_pressor"),
        (of(late, "hr") < 0).alias("late_slower"),
        F.avg(F.when(gain & early, F.abs(d))).alias("early_size"),
        F.avg(F.when(gain & late, F.abs(d))).alias("late_size"),
    )
    lasting = F.col("early_pressor") & F.col("early_lower") & F.col("late_pressor") & F.col("late_lower")
    # The names of the classes.
    found = (
        F.when((F.coalesce("least_n", F.lit(0)) < LEAST_PAIRS) | (F.col("known") < 6), "NONESTIMABLE_DUE_TO_SEQUENCE_SCARCITY")
        .when(F.col("signs") > 1, "METHOD_DEPENDENT_TEMPORAL_PATTERN")
        .when(lasting & (F.col("late_size") >= 0.67 * F.col("early_size")), "EARLY_PRESSOR_LOWER_BRS_PERSISTS_LATE")
        .when(lasting, "EARLY_PRESSOR_LOWER_BRS_ATTENUATES_LATE")
        .when(F.col("late_higher") & F.col("late_slower"), "LATE_SHIFT_TOWARD_HIGHER_BRS_LOWER_HR")
        .otherwise("NO_CLEAR_EARLY_LATE_PATTERN")
    )
    return row.withColumn("class", found)


def association_class(rho: DataFrame, omitted: DataFrame, slope: DataFrame) -> DataFrame:
    """One row: rho(method, n, rho) of the branches, omitted(method, rho) with each participant left out, slope(b) of the adjusted model."""
    of = lambda m, c="rho": F.max(F.when(F.col("method") == m, F.col(c)))
    a = rho.agg(of("REF").alias("rho"), *[(of(m, "n") < LEAST_PAIRS).alias(f"few_{m}") for m in ("A0_MAX", "A1_MAX")], *[(of(m) <= 0).alias(f"down_{m}") for m in ("A0_MAX", "A1_MAX")])
    b = omitted.where("method = 'REF'").agg(F.coalesce(F.bool_and(F.coalesce(F.col("rho") <= 0, F.lit(False))), F.lit(True)).alias("no_reversal"))
    row = a.crossJoin(b).crossJoin(slope.agg(F.max("b").alias("slope")))  # one row each
    fits = [F.coalesce(F.col(f"few_{m}"), F.lit(True)) | F.coalesce(F.col(f"down_{m}"), F.lit(False)) for m in ("A0_MAX", "A1_MAX")]
    # The names of the classes.
    found = (
        F.when((F.col("rho") < 0) & F.col("no_reversal") & fits[0] & fits[1] & (F.col("slope") <= 0), "CONSISTENT_EXPLORATORY_ASSOCIATION")
        .when(F.col("rho") < 0, "SUGGESTIVE_BUT_INFLUENCE_SENSITIVE")
        .when(F.col("rho") >= 0, "NO_EVIDENCE_OF_MONOTONIC_ASSOCIATION")
        .otherwise("INCONCLUSIVE")
    )
    return row.select("rho", "no_reversal", fits[0].alias("A0_MAX_fits"), fits[1].alias("A1_MAX_fits"), "slope", found.alias("class"))
