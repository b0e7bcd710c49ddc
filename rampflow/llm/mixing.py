"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Along a stratum's documents,
ordered by size and id, these expectations are prefix-summed; one random offset is added; a document
is emitted once for each integer that its stretch crosses. A source has two strata: documents above
its mean size are drawn first, and the others' expectation is set so that it makes up for what the
draw of the large ones missed. The words taken so differ from the target by about one mean size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import n_words, ranked, staged

SEED = 20240517
#: No document is taken oftener than this.
MOST = 3


def offset(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): 20 bits of an MD5, so that sums with it stay exact."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 5), 16, 10).cast("double") / float(1 << 20)


def targets(sizes: DataFrame) -> DataFrame:
    """Add weight and target to ``sizes(source, source_size)``.

    Weights are 1, 2, 3 repeating by code point, null last. Sources share all words by weight, but
    none gets over MOST times its own; the excess is reshared by weight. That is water-filling: by
    ascending ``MOST * size / weight``, a source is capped as long as what is left per weight would
    lift it over its cap, and what is left after all capped ones is shared by the rest. Ranks and sums before a
    source come from range partitions, so that sources need not fit one task.
    """
    s = sizes.withColumn("_last", F.col("source").isNull())
    s = ranked(s, [], ["_last", "source"], "_place", "mix-sources")
    s = s.withColumn("weight", F.col("_place") % 3 + 1).withColumn("_cap", MOST * F.col("source_size"))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    s = ranked(s, [], ["_ratio", "_last", "source"], "_order", "mix-ratios", totals={"_caps": "_cap", "_weights": "weight"})
    s = staged(s, "mix-weighed")
    whole = s.agg(F.sum("source_size").alias("_total"), F.sum("weight").alias("_weight"))
    share = (F.col("_total") - F.col("_caps")) / (F.col("_weight") - F.col("_weights"))
    s = s.crossJoin(F.broadcast(whole)).withColumn("_share", share).withColumn("_capped", F.col("_share") > F.col("_ratio"))
    # The share that holds for all uncapped sources is that of the first of them.
    level = s.agg(F.min(F.when(~F.col("_capped"), F.struct("_order", "_share")))["_share"].alias("_level"))
    s = s.crossJoin(F.broadcast(level))  # one row, like the totals
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("weight") * F.col("_level")).cast("double")
    return s.select("source", "source_size", "n", target.alias("target"))


def _copies(rate: Column, place: Column, u: Column) -> Column:
    i = place.cast("double")
    return F.least(F.floor((i + 1) * rate + u) - F.floor(i * rate + u), F.lit(MOST).cast("long"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of sources if its names have at most 8 MB; else the joins are shuffled."""
    name = next(c for c in df.columns if c in ("source", "_source"))
    size = df.agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + 48)).first()[0] or 0
    return F.broadcast(df) if size <= 8_000_000 else df


def mix_sources(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target double, taken long, copies long, and the columns ``keep``.

    size is the number of words; taken is size times the copies that the mix takes. Null texts have
    size 0 and null sources are a source of their own, with the last weight. Where all sizes of a source
    are 0, its target is 0 and nothing is taken. Documents of a source's mean size and below make up for what the draw
    of its larger ones missed, so their expected copies are near, not at, target / source_size. Texts of any length
    count whole. Of documents of one source, size and id, which one is taken oftener is not certain. Repeated rows are drawn each for itself. The result
    depends on ids, sizes, sources and the seed only. An empty table gives no rows; other columns of
    ``docs`` are ignored, whatever their names.
    """
    own = F.col(source_col).cast("string").alias("source")
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), own, n_words(F.col(text_col)).alias("size"), *keep), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sizes = staged(targets(sizes).withColumnRenamed("source", "_source"), "mix-targets")
    placed = rows.join(_small(sizes), rows["source"].eqNullSafe(sizes["_source"])).drop("_source")
    placed = placed.withColumn("large", F.col("size") * F.col("n") > F.col("source_size"))
    placed = ranked(placed, ["source", "large"], ["size", "doc_id"], "place", "mix-order")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    u = offset(F.col("source"), seed)
    first = _copies(rate, F.col("place"), u)
    drawn = placed.groupBy(F.col("source").alias("_source")).agg(
        F.sum(F.when(F.col("large"), F.col("size") * first).otherwise(0)).alias("by_large"),
        F.sum(F.when(F.col("large"), 0).otherwise(F.col("size"))).alias("small_size"),
    )
    drawn = staged(drawn, "mix-large")
    out = placed.join(_small(drawn), placed["source"].eqNullSafe(drawn["_source"]))
    rest = F.coalesce(F.try_divide(F.col("target") - F.col("by_large"), F.col("small_size").cast("double")), F.lit(0.0))
    rest = F.greatest(F.lit(0.0), F.least(F.lit(float(MOST)), rest))
    copies = F.when(F.col("large"), first).otherwise(_copies(rest, F.col("place"), u))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *keep)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^ \x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT source, source_size, n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), r AS (
  SELECT *, {MOST} * source_size::DOUBLE / weight AS ratio, sum(source_size) OVER () AS total FROM w
), p AS (
  SELECT *, (total - coalesce(sum({MOST} * source_size) OVER (ORDER BY ratio, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM r
), t AS (
  SELECT source, source_size, n,
         CASE WHEN share > ratio THEN ({MOST} * source_size)::DOUBLE
              ELSE weight * first_value(share) OVER (ORDER BY share > ratio, ratio, source NULLS LAST) END AS target,
         ('0x' || substr(md5('{SEED}:' || coalesce('=' || source, '')), 1, 5))::BIGINT::DOUBLE / 1048576.0 AS u
  FROM p
), o AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.u, d.size * t.n > t.source_size AS large,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0 END AS rate,
         (row_number() OVER (PARTITION BY d.source, d.size * t.n > t.source_size ORDER BY d.size, d.doc_id NULLS FIRST) - 1)::DOUBLE AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, least(floor((i + 1) * rate + u) - floor(i * rate + u), {MOST}) AS first FROM o
), b AS (
  SELECT source, sum(CASE WHEN large THEN size * first ELSE 0 END) AS by_large,
         sum(CASE WHEN large THEN 0 ELSE size END)::DOUBLE AS small_size FROM f GROUP BY source
), g AS (
  SELECT f.*, greatest(0.0, least({MOST}.0, CASE WHEN b.small_size > 0 THEN (f.target - b.by_large) / b.small_size ELSE 0.0 END)) AS rest
  FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
), c AS (
  SELECT *, CASE WHEN large THEN first ELSE least(floor((i + 1) * rest + u) - floor(i * rest + u), {MOST}) END::BIGINT AS copies FROM g
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM c
"""
