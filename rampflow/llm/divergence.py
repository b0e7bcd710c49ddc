"""Divergence of sources within a language, by a baseline-corrected inverted index, and the terms that set each apart.

Every source of a language gives every kept term a share p of a billion. Two sources differ by the sum over all V kept terms of
f(p, q) = floor((p - q)^2 / (p + q)). Most terms occur in few sources, so a pair starts at V times the f of two zero
counts, and only terms that occur correct it:

* a term of one source s corrects all its pairs by f(p_s, zero_t) - f(zero_s, zero_t), which depends on the term by its
  count alone; so the terms of a source are counted by p, and blocks of such counts meet blocks of the language's sources;
* a term's postings correct pairs of sources that both have it by what is left. Postings are cut into blocks
  of sources, and a pair of blocks is summed in a dense table inside a task: tables leave a task, not pairs of postings.

Terms are counted per batch of documents before anything moves, so frequent terms and hot sources are small.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, staged

#: In UTF-8 all other characters of a term are bytes from 0x80 on.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Bytes of a text that are looked at together, entries that a task counts before it hands them on.
STRETCH, COUNTED = 1 << 20, 100_000
#: Sources of a block of postings, tables that a task holds, pairs that it sums at a time, counts of a block of a source's shares.
BLOCK, TABLES, PAIRS, SHARES = 128, 128, 1 << 19, 4_096
UNIT = 1_000_000_000


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, A-Z lower-cased; texts of any length are read in stretches that end between terms."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and TERM.match(text, end, end + 1):
            end += 1
        yield TERM.findall(text[at:end].lower())
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, occurrences, documents) of some documents; a null term for each group that is met."""
    seen: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = pa.array([None, *n], pa.binary()).cast(pa.string())
            group = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*group, terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])
        seen.clear()
        pa.default_memory_pool().release_unused()

    for b in batches:
        lang, source = b.column(0).to_pylist(), b.column(1).to_pylist()
        for i, text in enumerate(b.column(2).cast(pa.binary())):
            n, docs = seen.setdefault((lang[i], source[i]), (Counter(), Counter()))
            own: set[bytes] = set()
            held -= len(n)
            for terms in _stretches(text.as_py()):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            held += len(n) + 1
            if held >= COUNTED:
                yield from out()
                held = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): a term's occurrences and documents in a group; a row of null term for every group."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    made = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly for all counts."""
    big = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (big(n) + F.lit(2).cast("decimal(20,0)")), big(total + 2 * terms))).cast("long")


def _between(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of pairs of sources for terms that both have, summed over the terms of a task."""
    held: dict[tuple, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, lo, hi), table in held.items():
            table = table.reshape(BLOCK, BLOCK)
            i, j = np.nonzero(table)
            made = [pa.array(x) for x in (lo * BLOCK + i, hi * BLOCK + j, table[i, j])]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(i)), *made], ["lang", "a", "b", "value"])
        held.clear()

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "lo", "hi")), strict=True))
        lists = batch.column("place")
        sizes = np.diff(lists.offsets.to_numpy())
        place, p, zero = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("place", "p", "zero"))
        ends = np.cumsum(sizes)
        for key in dict.fromkeys(keys):
            if key not in held:
                if len(held) >= TABLES:
                    yield from out()
                held[key] = np.zeros(BLOCK * BLOCK, np.int64)
            rows = np.array([k == key for k in keys])
            for at in np.array_split(np.flatnonzero(rows), 1 + int((sizes[rows].astype(np.int64) ** 2).sum()) // PAIRS):
                # Entry i of a term meets the later ones of the term; only pairs of the two blocks are this table's.
                i = np.concatenate([np.arange(ends[r] - sizes[r], ends[r]) for r in at] or [np.empty(0, np.int64)])
                later = np.repeat(ends[at], sizes[at]) - i - 1
                a = np.repeat(i, later)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later)
                a, b = np.where(place[a] < place[b], a, b), np.where(place[a] < place[b], b, a)
                mine = (place[a] // BLOCK == key[1]) & (place[b] // BLOCK == key[2])
                a, b = a[mine], b[mine]
                value = between(p[a], p[b]) - between(p[a], zero[b]) - between(zero[a], p[b]) + between(zero[a], zero[b])
                # Sums of so few values are whole numbers in double precision too.
                sums = np.bincount((place[a] % BLOCK) * BLOCK + place[b] % BLOCK, value, BLOCK * BLOCK)
                held[key] += sums.astype(np.int64)
    yield from out()


def _one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Corrections of a source's pairs with a block of sources for the terms that the source has, by their shares."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            p, n, zeros = (np.asarray(x, np.int64) for x in (r.p, r.times, r.zeros))
            gain = between(p[:, None], zeros) - between(np.int64(r.zero), zeros)
            yield pd.DataFrame({"lang": r.lang, "a": r.place, "b": np.asarray(r.places, np.int64), "value": n @ gain})


def audit_sources(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """How far each source of a language is from each other one, and its ``top`` terms that are commoner there than in the language.

    Null text, lang and source are ''. Terms are runs of ASCII letters and of all characters beyond ASCII, with A-Z
    lower-cased; a language keeps the V terms of at least ``least`` of its documents (rows: repeats count each). A group's share
    of a term is 1 + floor(1e9 * (count + 2) / (N + 2 V)), N its occurrences of kept terms.

    Returns lang, source, part, item, value long, rank int (from 1 per group and part; value descending, item by UTF-8
    ascending). Part ``pair``: item is another source of the language, all of them; 0 without kept terms. Part ``term``: kept
    terms that occur in the group with a larger share than in the language. Groups without terms have pairs;
    a language of one source has none. No rows give no rows; other columns are ignored, whatever their names. Values are exact
    for counts below 1e18; equal values rank by item.
    """
    spark = docs.sparkSession
    counts = staged(term_counts(docs), "divergence-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= least)
    kept = staged(kept.drop("docs"), "divergence-kept")
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("all"))
    found = staged(counts.where("term is not null").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "whole"), "divergence-found")
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where("term is null").select("lang", "source").join(languages, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0)
    # A share of nothing, where a language keeps no term, is never used: its pairs are 0 whatever it is.
    room = F.greatest(F.col("terms"), F.lit(1))
    groups = groups.withColumns({"zero": _share(F.lit(0), F.col("size"), room), "place": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1})
    groups = staged(groups, "divergence-groups")

    mine = F.struct("size", "terms", "all", "zero", "place")
    entries = found.join(groups.select("lang", "source", mine.alias("g")), ["lang", "source"]).select("lang", "source", "term", "n", "whole", "g.*")
    entries = staged(entries.withColumn("p", _share(F.col("n"), F.col("size"), F.col("terms"))), "divergence-entries")

    # Sources of a language in blocks; a posting goes to every pair of blocks that its own block is part of.
    blocks = groups.groupBy("lang", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.collect_list("place").alias("places"), F.collect_list("zero").alias("zeros"))
    last = groups.groupBy("lang").agg(F.floor(F.max("place") / BLOCK).alias("last"))
    own = F.floor(F.col("place") / BLOCK)
    posted = entries.join(last, "lang").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    posted = posted.groupBy("lang", "term", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"))
    posted = posted.agg(F.collect_list("place").alias("place"), F.collect_list("p").alias("p"), F.collect_list("zero").alias("zero"))
    some = "lang string, a long, b long, value long"
    both = posted.where(F.size("place") > 1).mapInArrow(_both, some)

    shares = entries.groupBy("lang", "place", "zero", "p").agg(F.count(F.lit(1)).alias("times"))
    nth = F.row_number().over(Window.partitionBy("lang", "place").orderBy("p")) - 1
    shares = shares.withColumn("part", F.floor(nth / SHARES)).groupBy("lang", "place", "zero", "part").agg(F.collect_list("p").alias("p"), F.collect_list("times").alias("times"))
    one = shares.join(blocks, "lang").mapInPandas(_one, some).where("a <> b")
    # A correction is one of both its sources.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    corrections = both.unionByName(one).select("lang", "value", F.inline(ways)).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))

    a = groups.select("lang", "source", "terms", F.col("place").alias("a"), F.col("zero").alias("za"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("zero").alias("zb"))
    pairs = a.join(b, "lang").where("a <> b").join(corrections, ["lang", "a", "b"], "left")
    value = F.col("terms") * _between(F.col("za"), F.col("zb")) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    q = _share(F.col("whole"), F.col("all"), F.col("terms"))
    terms = entries.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _between(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 10),
lv AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS size FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY ALL),
gs AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gs.lang, gs.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (gs.size + 2 * lv.v) AS p, 1 + (1000000000::HUGEINT * (v.n + 2)) // (lv.size + 2 * lv.v) AS q
  FROM gs JOIN v USING (lang) JOIN lv USING (lang) LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
k AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
"""
