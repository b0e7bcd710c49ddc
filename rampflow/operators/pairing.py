"""Pairing of two event series of a subject: first follower within a window, many-to-one or one-to-one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scans
from .grouped import per_row


def first_follower(left: DataFrame, right: DataFrame, within: float, key: str = "subject", t: str = "t") -> DataFrame:
    """For each left event the first right event of the key in [t, t + within]; a right event may serve several.

    Time is cut into buckets as long as the window, so the join is on (key, bucket) with each right
    event in two buckets, not on the key's whole history.
    """
    bucket = lambda c: F.floor(c / within).cast("long")
    a = left.select(key, F.col(t).alias("t_left"), bucket(F.col(t)).alias("_b"))
    b = right.select(key, F.col(t).alias("t_right"), F.explode(F.array(bucket(F.col(t)), bucket(F.col(t)) - 1)).alias("_b"))
    hits = a.join(b, [key, "_b"]).where((F.col("t_right") >= F.col("t_left")) & (F.col("t_right") <= F.col("t_left") + within))
    return hits.groupBy(key, "t_left").agg(F.min("t_right").alias("t_right"))


def one_to_one(left: DataFrame, right: DataFrame, within: float, key: str = "subject", t: str = "t") -> DataFrame:
    """The same in order of time with every right event used once: greedy, so sequential, but only as long as left events follow closely.

    Time is cut into buckets as long as the window. Where a bucket has no left event, nothing before it can take a right event
    after it, so a key falls into runs of consecutive buckets that are paired each for itself. Runs are found by a scan of the
    distinct buckets in ranges; a key with all rows is many runs unless its left events never pause for a window.
    """
    bucket = lambda c: F.floor(c / within).cast("long")
    a = left.select(key, F.col(t).cast("double").alias("t")).withColumn("_b", bucket(F.col("t")))
    b = right.select(key, F.col(t).cast("double").alias("t")).withColumn("_b", bucket(F.col("t")))
    runs = scans.runs(a.select(key, "_b").distinct(), key, "_b", out="_run")
    lefts = a.join(runs, [key, "_b"]).groupBy(key, "_run").agg(F.sort_array(F.collect_list("t")).alias("_lefts"))
    # A right event is for lefts of its own bucket's run, or of the bucket before.
    own, before = runs.select(key, "_b", F.col("_run").alias("_own")), runs.select(key, (F.col("_b") + 1).alias("_b"), F.col("_run").alias("_before"))
    rights = b.join(own, [key, "_b"], "left").join(before, [key, "_b"], "left").withColumn("_run", F.coalesce("_own", "_before")).where("_run is not null")
    rights = rights.groupBy(key, "_run").agg(F.sort_array(F.collect_list("t")).alias("_rights"))

    def kernel(_, x, y):
        out, j = [], 0
        for v in x:
            j += int(np.searchsorted(y[j:], v))
            if j < len(y) and y[j] <= v + within:
                out.append((float(v), float(y[j])))
                j += 1
        return out

    met = lefts.join(rights, [key, "_run"]).select(key, "_run", "_lefts", "_rights")
    return per_row(met, [key, "_run"], kernel, "t_left double, t_right double").drop("_run")


def in_order(pairs: DataFrame, key: str = "subject") -> DataFrame:
    """Per key whether each left event precedes its right one, and each right one the next left event."""
    w = Window.partitionBy(key).orderBy("t_left")
    rows = pairs.withColumn("_next", F.lead("t_left").over(w))
    fine = (F.col("t_left") < F.col("t_right")) & (F.col("_next").isNull() | (F.col("t_right") < F.col("_next")))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(fine).alias("in_order"))
