"""Connected components of an edge table by hooking and pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of ``edges(a, b)``; comp is one node of the component, the same for all of it.

    Each round hooks every component to its least neighbour, follows the hooks twice and contracts
    the edges, so the edge table shrinks until it is empty. All steps are group-bys and equi-joins.
    """
    e = staged(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    labels = staged(e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("comp", F.col("node")), f"{name}-labels")
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        hook = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up")).withColumnRenamed("a", "c"), f"{name}-hooks")
        for _ in range(2):
            up = hook.select(F.col("c").alias("up"), F.col("up").alias("far"))
            hook = hook.join(up, "up", "left").select("c", F.coalesce("far", "up").alias("up"))
        hook = staged(hook, f"{name}-jumped")
        labels = staged(labels.join(hook, labels["comp"] == hook["c"], "left").select("node", F.coalesce("up", "comp").alias("comp")), f"{name}-labels")
        left = hook.select(F.col("c").alias("a"), F.col("up").alias("ua"))
        right = hook.select(F.col("c").alias("b"), F.col("up").alias("ub"))
        e = staged(e.join(left, "a").join(right, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a <> b").distinct(), f"{name}-edges")
    return labels
