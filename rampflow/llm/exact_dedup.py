"""Exact duplicates by skew-safe combining.

Rows are combined three times, each time by digest *and* full content, so that two texts of one
digest never merge: inside each input task, among the tasks' winners of one (salt, digest), and
among the salts' winners of one digest. A group that holds a third of all rows reaches the second
step as one row per task and salt and the third as one row per salt. Documents then take their group by
digest: groups beyond a quarter of an even share of all rows are broadcast (there are at most four a shuffle
partition), so their documents stay where they are read; the others are joined by a shuffle. Only if some
digest has two texts (never seen for SHA-256) those documents compare texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, fresh, looked_up, staged


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, norm, keep_id, group_size) of ``rows(doc_id, digest, norm)``, combined by task, salt and digest."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    # Partial aggregation is the local step; its shuffle brings a (salt, digest) together.
    by_salt = rows.groupBy("salt", "digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return by_salt.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_duplicates(docs: DataFrame, salts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size long, kept boolean, text_sha256.

    Of equal normalised texts the smallest doc_id stays (ties of id: all rows of that id are kept,
    being one document). Null and empty texts are equal to each other. Rows of null id count in
    group_size and are kept only if no row of the group has an id. Texts of any length count whole. An
    empty table gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    rows = rows.select("doc_id", F.sha2("norm", 256).alias("digest"), "norm")
    winners = staged(_winners(rows, salts).drop("norm"), "exact-winners")
    twice = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")

    if twice.isEmpty():
        out = looked_up(rows.select("doc_id", "digest"), winners, "digest", "group_size", "doc_id")
    else:
        twice = staged(twice, "exact-twice")
        full = rows.join(twice, "digest", "left_semi")
        apart = full.join(_winners(full, salts), ["digest", "norm"]).select("doc_id", "digest", "keep_id", "group_size")
        single = staged(winners.join(twice, "digest", "left_anti"), "exact-single")
        out = looked_up(rows.select("doc_id", "digest"), single.select(*winners.columns), "digest", "group_size", "doc_id").unionByName(apart)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, salts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each normalised text, with all their columns.

    The smallest id of a text stays, and one row of it where rows are repeated; a text that has rows of null
    id alone keeps one of them. Null and empty texts are one text. Winners find their row by (id, digest),
    keys that no group of copies makes heavy.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(norm, 256).alias("digest"), norm.alias("norm"))
    winners = _winners(rows, salts)
    if (twice := staged(winners.withColumn("short", F.xxhash64("norm")).drop("norm"), "exact-winners")).groupBy("digest").count().where("count > 1").isEmpty():
        key, winners = F.lit(0), twice.withColumn("_of", F.lit(0))
    else:
        key, winners = F.xxhash64(norm), twice.withColumn("_of", F.col("short"))
    digest, of, nth = (fresh(docs, x) for x in ("_digest", "_of", "_nth"))
    marked = docs.withColumns({digest: F.sha2(norm, 256), of: key})
    d, o, k = (fresh(marked, x) for x in ("_w_digest", "_w_of", "_w_keep"))
    winners = winners.select(F.col("digest").alias(d), F.col("keep_id").alias(k), F.col("_of").alias(o))
    kept = marked.join(winners, (F.col(digest) == F.col(d)) & F.col(id_col).eqNullSafe(F.col(k)) & (F.col(of) == F.col(o)), "left_semi")
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(digest, id_col, of).orderBy(F.lit(0))))
    return kept.where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB has no digest collision to settle either; the grouping by text itself is the plain definition.
ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
