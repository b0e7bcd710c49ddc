"""Checks of a release: what result tables say against known results, one row a figure.

Each ``..._values`` turns result tables of the engine into (name, value) rows by aggregates; ``against`` holds them against
known results. Counts and structure (how many settings, cells, tests) are figures like others, so a table that lost or
gained rows fails by its count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit

KNOWN = "check string, name string, value double, tolerance double"


def figures(df: DataFrame, **values: Column) -> DataFrame:
    """One aggregation of ``df`` as (name, value) rows."""
    one = df.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in values])))


def together(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def only(column: str, where: Column) -> Column:
    """The value of the one row where a condition holds; null if there is none, or more than one."""
    return F.when(F.count_if(where) == 1, F.max(F.when(where, F.col(column))))


def read_known(spark: SparkSession, path: str, tolerances: dict[tuple[str, str], float] | None = None, tolerance: float = 5e-7) -> DataFrame:
    """Known results from a JSON object of objects of numbers: check, name, value, tolerance. Whatever is no number is left out."""
    text = spark.read.text(path, wholetext=True)
    outer = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("check", "_body")).where("_body like '{%'")
    rows = outer.select("check", F.explode(F.from_json("_body", "map<string, string>")).alias("name", "_v"))
    rows = rows.select("check", "name", F.col("_v").try_cast("double").alias("value")).where("value is not null")
    special = [F.when((F.col("check") == c) & (F.col("name") == n), F.lit(float(t))) for (c, n), t in (tolerances or {}).items()]
    return rows.withColumn("tolerance", F.coalesce(*special, F.lit(float(tolerance))))


def against(values: dict[str, DataFrame], known: DataFrame) -> DataFrame:
    """A row (name, passed, detail) for every known figure of the named checks; a figure that no table has fails."""
    named = together(*[v.select(F.concat_ws("/", F.lit(c), "name").alias("name"), "value") for c, v in values.items()])
    mine = known.where(F.col("check").isin(list(values))).select(F.concat_ws("/", "check", "name").alias("name"), "value", "tolerance")
    return audit.anchors(named, mine)


def central_values(pairs: DataFrame, interval: DataFrame, test: DataFrame) -> DataFrame:
    """Of pairs(d) of the main contrast, its mean's interval (low, high) and its rank test (p)."""
    return together(
        figures(pairs, n=F.count("d"), mean_difference=F.avg("d"), negative_participants=F.count_if(F.col("d") < 0), cohens_dz=F.try_divide(F.avg("d"), F.stddev_samp("d"))),
        figures(interval.where("statistic = 'mean'"), bca95_low=F.max("low"), bca95_high=F.max("high"), intervals=F.count(F.lit(1))),
        figures(test, wilcoxon_p=F.max("p"), tests=F.count(F.lit(1))),
    )


def landscape_values(effects: DataFrame, reference: str, p: str | None = None) -> DataFrame:
    """Of effects(setting, direction, n, mean_difference) of the main contrast: every setting in every direction of ramps."""
    m, d = F.col("mean_difference"), F.col("direction")
    every = d == "all"
    values = {
        "rows": F.count(F.lit(1)),
        "settings": F.count_distinct("setting"),
        **{f"settings_{x}": F.count_if(d == x) for x in ("all", "up", "down")},
        "reference_all": only("mean_difference", every & (F.col("setting") == reference)),
        "median_all": F.median(F.when(every, m)),
        "minimum_all": F.min(F.when(every, m)),
        "maximum_all": F.max(F.when(every, m)),
        **{f"{x}_negative": F.count_if((d == x) & (m < 0)) for x in ("all", "up", "down")},
        "all_up_down_negative_total": F.count_if(m < 0),
        "positive_all": F.count_if(every & (m > 0)),
        "evaluable_n_min": F.min(F.when(every, F.col("n"))),
        "evaluable_n_max": F.max(F.when(every, F.col("n"))),
    }
    if p:
        values["minimum_p_among_positive_all"] = F.min(F.when(every & (m > 0), F.col(p)))
    return figures(effects, **values)


def coherence_values(contrasts: DataFrame, prevalence: DataFrame, mcnemar: DataFrame, cochran: DataFrame, sizes: tuple[int, int] = (512, 256)) -> DataFrame:
    """Of contrasts(size, contrast, mean_difference, p), prevalence(phase, successes) and both comparisons' p."""
    main = F.col("contrast") == "Stim-Pre"
    by = {f"{k}_{v}": only(c, main & (F.col("size") == n)) for k, n in zip(("reference", "sensitivity"), sizes, strict=True) for v, c in (("mean_difference", "mean_difference"), ("wilcoxon_p", "p"))}
    return together(
        figures(contrasts, **by),
        figures(prevalence, **{f"{p.lower()}_significant": only("successes", F.col("phase") == p) for p in ("Pre", "Stim", "Post")}),
        figures(mcnemar, mcnemar_p=only("p", main)),
        figures(cochran, cochran_q_p=F.when(F.count(F.lit(1)) == 1, F.max("p"))),
    )


def haemodynamics_values(contrasts: DataFrame) -> DataFrame:
    """Of contrasts(metric, contrast, mean_difference, p, q) of the context family."""
    main = (F.col("metric") == "mean_sbp") & (F.col("contrast") == "Stim-Pre")
    return figures(contrasts, mean_sbp_stim_minus_pre=only("mean_difference", main), wilcoxon_p=only("p", main), bh_q=only("q", main), metrics=F.count_distinct("metric"))


def autoregression_values(fits: DataFrame, tests: DataFrame, mcnemar: DataFrame, cochran: DataFrame, direction: str = "rri_to_sbp", orders: tuple[int, int] = (1, 10)) -> DataFrame:
    """Of fits (one a cell), tests(direction, nominal, fdr), and comparisons of prevalence in one direction.

    Where a direction is significant everywhere Cochran's test has nothing to compare and McNemar's p is 1.
    """
    ok, mine = F.col("reason") == "NA", F.col("direction") == direction
    white, normal = F.col("whiteness_p") >= 0.05, F.col("normality_p") >= 0.05
    return together(
        figures(fits, unique_fits=F.count_distinct("subject", "phase"), rows=F.count(F.lit(1)), succeeded=F.count_if(ok), stable=F.count_if(ok & F.col("stable")), whiteness_pass=F.count_if(white), normality_pass=F.count_if(normal), both_pass=F.count_if(white & normal), odd_orders=F.count_if(ok & ~F.col("order").between(*orders))),
        figures(tests, direction_rows=F.count_if(mine), direction_nominal=F.count_if(mine & F.col("nominal")), direction_fdr=F.count_if(mine & F.col("fdr"))),
        figures(cochran, cochran_not_estimable=F.count_if(mine & (F.col("status") == "not_estimable") & F.col("p").isNull() & (F.col("reason") == "no_within_participant_variation_across_phases"))),
        figures(mcnemar, mcnemar_p=only("p", mine & (F.col("contrast") == "Stim-Pre"))),
    )


def branch_values(contrasts: DataFrame, intervals: DataFrame, branches: tuple[str, ...]) -> DataFrame:
    """Of contrasts(setting, mean_difference) of the main contrast and the reference's interval: all other branches go the same way."""
    m, s = F.col("mean_difference"), F.col("setting")
    return together(
        figures(contrasts, branches=F.count_distinct(F.when(s.isin(*branches), s)), rows=F.count(F.lit(1)), negative_branches=F.count_if(s.isin(*branches) & (m < 0)), ref_mean_difference=only("mean_difference", s == "REF")),
        figures(intervals.where("setting = 'REF' and statistic = 'mean'"), ref_low=F.max("low"), ref_high=F.max("high")),
    )


def coupling_values(contrasts: DataFrame) -> DataFrame:
    """Of contrasts(method, direction, contrast, q): the primary tests, and how many survive."""
    mine = (F.col("contrast") == "Stim-Pre") & F.col("q").isNotNull()
    return figures(contrasts, primary_tests=F.count_if(mine), primary_families=F.count_distinct(F.when(mine, F.struct("method", "direction"))), primary_below_005=F.count_if(mine & (F.col("q") < 0.05)))


#: What a tree of files that is published must not hold, by name.
UNSAFE = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_token": r"(?i)\b(?:ghp|gho|ghs|github_pat|glpat|xox[abp])[-_][A-Za-z0-9_-]{16,}",
    "cloud_key": r"\bAKIA[0-9A-Z]{16}\b",
    "password": r"(?i)\b(?:password|passwd|secret)\s*[:=]\s*[\"']?[^\s\"']{6,}",
    "home_folder": r"(?i)(?:/home/|/Users/|[A-Z]:\\Users\\)[A-Za-z0-9._-]+",
    "e_mail": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}\b",
}


def safe_tree(spark: SparkSession, folder: str, patterns: dict[str, str] | None = None, allowed: str | None = None) -> DataFrame:
    """A check for every unsafe pattern over all text files under ``folder``; hits on lines that match ``allowed`` don't count."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    if allowed:
        lines = lines.where(~F.col("value").rlike(allowed))
    return audit.forbidden(lines, patterns or UNSAFE)
