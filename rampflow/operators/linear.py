"""Least squares as aggregates: coefficients, HC3 errors, leverage, influence and residual tests of grouped rows.

A model of any number of rows is two aggregations and one small inverse a group; only the inverse, of one matrix a
group, is computed outside of Catalyst. Predictors are taken less their group's means throughout, and whether they are
collinear is judged on their correlations, so that offsets and units do not matter; the constant goes back to the
predictors as they are at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dist import chi2_sf, t_sf2
from ..session import ship


@dataclass
class Fit:
    """keys, y and names of the terms, constant first; ``rows`` has residual, leverage, cook and dfb_ columns."""

    keys: list[str]
    terms: list[str]
    y: str
    rows: DataFrame
    models: DataFrame


def _sums(terms: list[Column], weight: Column) -> Column:
    """The upper triangle of the weighted cross products, row by row."""
    return F.array(*[F.sum(a * b * weight) for i, a in enumerate(terms) for b in terms[i:]])


def _full(upper, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = upper
    return m + np.triu(m, 1).T


def _mapped(df: DataFrame, f, added: str) -> DataFrame:
    """Rows of ``df``, one a group, with what ``f(row)`` makes of each."""
    ship(df.sparkSession)
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches):
        for pdf in batches:
            made = [f(r) for r in pdf.itertuples(index=False)]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(made, columns=names)], axis=1)

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInPandas(run, f"{kinds}, {added}")


def fit(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> Fit:
    """Fit y on a constant and ``xs`` within each group; rows with a null in any of them take no part.

    A group of no more rows than terms, or of collinear columns, has null coefficients and everything that follows from them.
    """
    names, k = ["constant", *xs], len(xs) + 1
    df = df.dropna(subset=[y, *xs])
    plain = [F.col(x).cast("double") for x in xs]
    n = F.count(F.lit(1))
    sums = df.groupBy(*keys).agg(
        n.alias("n"),
        F.array(F.avg(y), *map(F.avg, plain)).alias("means_"),
        F.array(*[n * F.covar_pop(a, b) for i, a in enumerate(plain) for b in plain[i:]]).alias("xx_"),
        F.array(*[n * F.covar_pop(c, F.col(y)) for c in plain]).alias("xy_"),
        F.array(*[F.stddev_samp(c) for c in [F.col(y), *plain]]).alias("sd_"),
    )

    def solve(r):
        xx = _full(r.xx_, k - 1)
        size = np.sqrt(np.diag(xx))
        if r.n <= k or not (size > 0).all() or np.linalg.matrix_rank(xx / np.outer(size, size), hermitian=True) < k - 1:
            return None, None
        inv = np.zeros((k, k))
        inv[0, 0] = 1 / r.n
        inv[1:, 1:] = np.linalg.inv(xx / np.outer(size, size)) / np.outer(size, size)
        return [r.means_[0], *(inv[1:, 1:] @ np.array(r.xy_))], inv.ravel().tolist()

    solved = _mapped(sums, solve, "b_ array<double>, inv_ array<double>").select(*keys, "n", "means_", "sd_", "b_", "inv_")
    own = [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys]
    side = lambda t, *c: t.select(*[F.col(key).alias(f"_k_{key}") for key in keys], *c)
    drop = [f"_k_{key}" for key in keys]
    total = lambda parts: sum(parts[1:], parts[0])
    rows = df.join(side(solved, "n", "means_", "b_", "inv_"), own).drop(*drop)
    columns = [F.lit(1.0), *[c - F.col("means_")[i + 1] for i, c in enumerate(plain)]]
    rows = rows.withColumn("residual", F.col(y) - total([F.col("b_")[i] * c for i, c in enumerate(columns)]))
    rows = rows.withColumn("leverage", total([F.col("inv_")[i * k + j] * a * b for i, a in enumerate(columns) for j, b in enumerate(columns) if (i == 0) == (j == 0)]))
    e, h = F.col("residual"), F.col("leverage")
    u = e * e
    spread = rows.groupBy(*keys).agg(
        F.sum(u).alias("ee_"),
        F.sum(e * e * e).alias("e3_"),
        F.sum(u * u).alias("e4_"),
        _sums(columns, (e / (1 - h)) * (e / (1 - h))).alias("meat_"),
        F.array(*[F.sum(c * u) for c in columns]).alias("xu_"),
    )
    models = solved.join(side(spread, "ee_", "e3_", "e4_", "meat_", "xu_"), own).drop(*drop)
    rows = rows.join(side(spread, "ee_"), own).drop(*drop)
    s2 = F.col("ee_") / (F.col("n") - k)
    cook = u * h / (k * s2 * (1 - h) * (1 - h))
    loo = F.sqrt(F.greatest(F.lit(0.0), (F.col("ee_") - u / (1 - h)) / (F.col("n") - k - 1)))
    inv, mean = (lambda i, j: F.col("inv_")[i * k + j]), (lambda i: F.col("means_")[i])
    shift = lambda i: total([inv(i, j) * c for j, c in enumerate(columns) if (i == 0) == (j == 0)]) * e / (1 - h)
    # The constant at predictors of 0 is that at their means less the slopes times the means.
    slopes = range(1, k)
    moved = {0: shift(0) - (total([mean(i) * shift(i) for i in slopes]) if xs else F.lit(0.0)), **{i: shift(i) for i in slopes}}
    spread_of = {0: inv(0, 0) + (total([mean(i) * mean(j) * inv(i, j) for i in slopes for j in slopes]) if xs else F.lit(0.0)), **{i: inv(i, i) for i in slopes}}
    rows = rows.withColumns({"cook": cook, "large": cook > 4 / F.col("n"), **{f"dfb_{names[i]}": moved[i] / (loo * F.sqrt(spread_of[i])) for i in range(k)}})
    return Fit(keys, names, y, rows.drop("b_", "inv_", "ee_", "means_"), models)


def coefficients(model: Fit) -> DataFrame:
    """keys, term, n, b, hc3, p (Student's t) and beta (standardised; null for the constant), r2."""
    terms, k = model.terms, len(model.terms)

    def table(r):
        if r.b_ is None:
            return [{"term": t} for t in terms], None
        inv, back = np.array(r.inv_).reshape(k, k), np.eye(k)
        back[0, 1:] = -np.array(r.means_[1:])
        b = back @ np.array(r.b_)
        se = np.sqrt(np.diag(back @ inv @ _full(r.meat_, k) @ inv @ back.T))
        sd = list(r.sd_)
        p = [t_sf2(float(t), r.n - k) if r.n > k else None for t in b / se]
        return ([{"term": t, "b": float(b[i]), "hc3": float(se[i]), "p": p[i], "beta": float(b[i] * sd[i] / sd[0]) if i else None} for i, t in enumerate(terms)], float(1 - r.ee_ / (sd[0] ** 2 * (r.n - 1))))

    out = _mapped(model.models, table, "terms_ array<struct<term:string,b:double,hc3:double,p:double,beta:double>>, r2 double")
    return out.select(*model.keys, "n", "r2", F.inline("terms_"))


def residual_tests(model: Fit, order: str) -> DataFrame:
    """keys, test, statistic, p: Jarque-Bera, Breusch-Pagan, and Durbin-Watson in the order of a column (without p).

    Durbin-Watson looks at neighbours, so a group's residuals pass one task in order; all else is sums.
    """
    k = len(model.terms)

    def table(r):
        if r.b_ is None or not r.ee_ > 0:
            return ([{"test": "jarque_bera"}, {"test": "breusch_pagan"}],)
        s2 = r.ee_ / r.n
        jb = r.n / 6 * (r.e3_ / r.n / s2**1.5) ** 2 + r.n / 24 * (r.e4_ / r.n / s2**2 - 3) ** 2
        xu = np.array(r.xu_)
        fitted = xu @ np.array(r.inv_).reshape(k, k) @ xu - r.ee_**2 / r.n
        spread = r.e4_ - r.ee_**2 / r.n
        bp = r.n * fitted / spread if spread > 0 else 0.0
        return ([{"test": "jarque_bera", "statistic": float(jb), "p": chi2_sf(float(jb), 2)}, {"test": "breusch_pagan", "statistic": float(bp), "p": chi2_sf(float(bp), k - 1)}],)

    tests = _mapped(model.models, table, "tests_ array<struct<test:string,statistic:double,p:double>>").select(*model.keys, F.inline("tests_"))
    step = F.col("residual") - F.lag("residual").over(Window.partitionBy(*model.keys).orderBy(order))
    steps = model.rows.withColumn("_d", step).groupBy(*model.keys).agg((F.sum(F.col("_d") * F.col("_d")) / F.sum(F.col("residual") * F.col("residual"))).alias("statistic"))
    return tests.unionByName(steps.select(*model.keys, F.lit("durbin_watson").alias("test"), "statistic", F.lit(None).cast("double").alias("p")))

