"""How five quality filters interact: what each would remove at any place of any order, by lattice-edge aggregation.

Whether a filter removes a document depends on which filters came before it, not on their order. So there
are 80 edges (set of filters already applied, next filter), and each of the 120 orders is a path of five of them. Documents are
counted once by the set of filters that they fail; those counts, a few dozen a language, contribute to the edges, and
the edges are joined to the 600 steps of all paths.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, looked_up, staged

FILTERS = "ABCDE"
#: What a filter's failure needs: words, share of distinct words, share of capitals (both in percent).
WORDS, DISTINCT, CAPITALS = 100, 80, 10
MARKS = "[#$%&*|]"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, fails): the filters A to D that a document fails, as bits 1, 2, 4 and 8. Whole texts; null is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = rows.select("doc_id", "part", "text", F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("u"))
    bits = [
        F.col("n") < WORDS,
        100 * F.col("u") < DISTINCT * F.col("n"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > CAPITALS * F.length("text").cast("long"),
        F.col("text").rlike(MARKS),
    ]
    fails = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), fails.alias("fails"))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by the set of filters that they fail (E is bit 16) and their labels."""
    rows = staged(failures(docs).withColumn("at", F.monotonically_increasing_id()), "filters-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = looked_up(rows, staged(first, "filters-first"), "digest", "times", "at", how="left")
    rows = rows.withColumn("fails", F.col("fails") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0))
    # Rows of one id, of whatever number, are a few rows from here on.
    rows = rows.groupBy("doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(marked, "doc_id", "left").na.fill(False, ["good", "toxic"])
    return rows.groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Five filters in all 120 orders, within each language: what every step keeps and removes.

    A document fails A with under 100 words, B if its distinct words are under 80 % of them, C if capitals A-Z are over 10 % of
    its characters, D if it holds any of #$%&*|, E if a row of smaller doc_id anywhere in the table has the same text. Null
    texts are empty, a null lang is '' (one part with rows whose lang is ''). Rows of null doc_id are never later than
    others, and no row is later than them. Repeated rows are documents each for itself; they don't fail E
    by each other. A document is good or toxic if any of its rows in ``labels`` says 1.

    Returns 600 rows a part, none for an empty table: part, filter_order, step int, and long counts of the part's documents: kept
    (after this step), removed (here), redundant (fail this filter, were removed before), unique_fails (fail this filter alone),
    good_lost, toxic_lost (of those removed here), shapley (removed by this filter, summed over all orders). Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    sets = staged(failed_sets(docs, labels), "filters-sets")
    every = range(1 << len(FILTERS))
    edges = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(1 << i).alias("bit")) for s in every for i in range(len(FILTERS)) if not s >> i & 1])
    at = sets.select("*", F.inline(edges))
    fails = F.col("fails").bitwiseAND(F.col("bit")) > 0
    gone = F.col("fails").bitwiseAND(F.col("before")) > 0
    here = fails & ~gone
    tests = (~fails & ~gone, here, fails & gone, F.col("fails") == F.col("bit"), here & F.col("good"), here & F.col("toxic"))
    by_edge = at.groupBy("part", "before", "bit").agg(*[F.sum(F.when(t, F.col("n")).otherwise(0)).alias(c) for c, t in zip(COUNTS, tests, strict=True)])

    # An edge is on k! (4 - k)! paths, k the number of filters before it.
    paths = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))]), F.bit_count("before") + 1)
    by_filter = by_edge.groupBy(F.col("part").alias("_part"), F.col("bit").alias("_bit")).agg(F.sum(F.col("removed") * paths).alias("shapley"))
    by_edge = by_edge.join(by_filter, (F.col("part") == F.col("_part")) & (F.col("bit") == F.col("_bit"))).drop("_part", "_bit")

    steps = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, before, 1 << i))
            before |= 1 << i
    steps = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    return by_edge.join(F.broadcast(steps), ["before", "bit"]).select("part", "filter_order", "step", *COUNTS, "shapley")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT d.*, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c,
  regexp_matches(text, '[#$%&*|]') AS e0, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN e0 THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
  coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
z AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM o, range(1, 6) r(step)),
y AS (SELECT m.*, z.*, contains(fails, own) AS failing, len(list_filter(string_split(before, ''), lambda k: k <> '' AND contains(fails, k))) > 0 AS gone FROM m, z),
c AS (SELECT part, filter_order, step, own, count_if(NOT failing AND NOT gone)::BIGINT AS kept, count_if(failing AND NOT gone)::BIGINT AS removed, count_if(failing AND gone)::BIGINT AS redundant,
  count_if(fails = own)::BIGINT AS unique_fails, count_if(failing AND NOT gone AND good)::BIGINT AS good_lost, count_if(failing AND NOT gone AND toxic)::BIGINT AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM c
"""
