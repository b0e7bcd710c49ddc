"""Queries on the order tables: the engine's relational operators on any keyed table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import audit, context
from ..streaming import tumbling_bins
from .registry import query

_PHASE = "CASE WHEN extract(year FROM {0}) < 1994 THEN 'Pre' WHEN extract(year FROM {0}) < 1996 THEN 'Stim' ELSE 'Post' END"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phase(c):
    return F.when(F.year(c) < 1994, "Pre").when(F.year(c) < 1996, "Stim").otherwise("Post")


@query("tpch_context", f"SELECT coalesce(phase, 'All') AS phase, o_orderstatus AS status, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS mean_quantity FROM (SELECT {_PHASE.format('o_orderdate')} AS phase, * FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY GROUPING SETS ((phase, o_orderstatus), (o_orderstatus))")
def tpch_context(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", _phase("o_orderdate").alias("phase"))
    j = o.join(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    sets = j.groupingSets([["phase", "o_orderstatus"], ["o_orderstatus"]], "phase", "o_orderstatus")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))
    return out.select(F.coalesce("phase", F.lit("All")).alias("phase"), F.col("o_orderstatus").alias("status"), "n", "revenue", "mean_quantity")


@query("price_descriptives", "SELECT o_orderpriority AS priority, count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1")
def price_descriptives(spark, sf_dir):
    d = context.descriptives(_t(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority"), "o_totalprice", "priority").drop("iqr")
    return d.withColumns({c: F.round(c, 4) for c in ("mean", "sd", "median", "q1", "q3")})


@query("top_three", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 3")
def top_three(spark, sf_dir):
    return _t(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(3).select("c_custkey", "c_acctbal")


@query("worst_divergence", "SELECT l_returnflag, max(abs(l_extendedprice - 1000 * l_quantity)) AS divergence, arg_max(l_orderkey * 10 + l_linenumber, (abs(l_extendedprice - 1000 * l_quantity), l_orderkey, l_linenumber)) AS at FROM lineitem GROUP BY l_returnflag")
def worst_divergence(spark, sf_dir):
    d = F.abs(F.col("l_extendedprice") - 1000 * F.col("l_quantity"))
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.max(d).alias("divergence"), F.max_by(F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.struct(d, "l_orderkey", "l_linenumber")).alias("at"))


@query("key_difference", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def key_difference(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).exceptAll(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct())


@query("key_intersection", "SELECT s_nationkey AS key FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def key_intersection(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")).intersect(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")))


@query("pivot_status", "SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    wide = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("priority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("unpivot_prices", "SELECT p_brand, 'p_size' AS metric, round(sum(p_size), 2)::DOUBLE AS value FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'p_retailprice', round(sum(p_retailprice), 2) FROM part GROUP BY p_brand")
def unpivot_prices(spark, sf_dir):
    long = _t(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice").unpivot(["p_brand"], ["p_size", "p_retailprice"], "metric", "value")
    return long.groupBy("p_brand", "metric").agg(F.round(F.sum("value"), 2).alias("value"))


@query("missing_grid", "SELECT n.n_name, s.m AS segment, count(c.c_custkey) AS n FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment AS m FROM customer) s LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.m GROUP BY ALL")
def missing_grid(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    grid = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name").crossJoin(c.select(F.col("c_mktsegment").alias("segment")).distinct())  # 25 nations by a handful of segments
    n = c.groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["n_nationkey", "segment"], "left").select("n_name", "segment", F.coalesce("n", F.lit(0)).alias("n"))


@query("order_gaps", "WITH g AS (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, count(gap) AS n, min(gap) AS least, max(gap) AS most FROM g GROUP BY o_custkey")
def order_gaps(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    g = _t(spark, sf_dir, "orders").withColumn("gap", F.date_diff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long"))
    return g.groupBy("o_custkey").agg(F.count("gap").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most"))


@query("table_checks", "SELECT 'order_keys_unique' AS name, max(k) <= 1 AS passed, max(k)::VARCHAR AS detail FROM (SELECT count(*) AS k FROM orders GROUP BY o_orderkey) UNION ALL SELECT 'nation_count', count(*) = 25, count(*)::VARCHAR FROM nation UNION ALL SELECT 'status_letters', count(*) FILTER (NOT regexp_full_match(o_orderstatus, '[FOP]')) = 0, (count(*) FILTER (NOT regexp_full_match(o_orderstatus, '[FOP]')))::VARCHAR FROM orders UNION ALL SELECT 'one_europe', count(*) FILTER (r_name = 'EUROPE') = 1, (count(*) FILTER (r_name = 'EUROPE'))::VARCHAR FROM region")
def table_checks(spark, sf_dir):
    o, n = _t(spark, sf_dir, "orders"), F.count(F.lit(1))
    return audit.all_checks(
        audit.unique(o, ["o_orderkey"], "order_keys_unique"),
        audit.check(_t(spark, sf_dir, "nation"), "nation_count", n == 25, n),
        audit.matching(o, "o_orderstatus", "[FOP]", "status_letters"),
        audit.exactly_one(_t(spark, sf_dir, "region"), F.col("r_name") == "EUROPE", "one_europe"),
    )


@query("stream_bins", "SELECT epoch_us(date_trunc('day', ts)) // 1000000 AS bin, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY ALL")
def stream_bins(spark, sf_dir):
    """The stream's own plan over a finished table; tests run it as a stream and compare."""
    out = tumbling_bins(_t(spark, sf_dir, "events"), "1 day", keys=("event_type",))
    return out.select(F.unix_seconds("bin_start").alias("bin"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))
