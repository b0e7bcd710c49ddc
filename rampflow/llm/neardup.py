"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles (two shingles of a corpus
share a hash with probability 2**-64). Equal sets form a class, and only classes are compared:

1. sketch of 256 coordinates per class; 32 bands of 4 coordinates are the candidate buckets (a
   pair at similarity 0.8 shares none with probability 5e-8);
2. star links: the head of a bucket is its class with the most neighbours over all its buckets, so
   that the buckets of one text and its near copies have one head, the text itself. The other classes
   are compared with the head on the full sets, which gives first components;
3. the rest: of a bucket whose classes are in several components, those outside its largest
   component are compared with all others, in blocks: first by sketches (with six standard deviations of
   allowance), then on the full sets. A block gives a spanning forest of its links, at most one
   link a row. Where more classes are open than a block holds, its chunks are settled each for itself
   first, and only what then is open meets the other chunks.

A bucket's work is dealt in blocks of bounded size, so no group has to fit in a task. Nothing is
capped: every pair that shares a bucket is linked, in one component already, or compared. A bucket of m
classes is copied once, and once more for each BLOCK of open classes; only many classes of one bucket that no
link joins make it more than a few copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import neardup_kernels as K
from .common import exact, looked_up, restored, small_batches, staged
from .components import components

#: Classes in a chunk of a bucket; a block compares at most BLOCK open classes with a chunk.
BLOCK = 256
#: Classes that are compared with one copy of their head.
STAR = 256


def _sketched(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, key, band, low = [], [], [], []
            for text in pdf["text"]:
                s = K.shingles(text, width)
                n.append(len(s))
                key.append(K.set_key(s) if len(s) else None)
                sk = K.sketch(s) if len(s) else None
                band.append(K.bands(sk) if len(s) else None)
                low.append(K.compact(sk) if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "at": pdf["at"], "n_shingles": n, "set_key": key, "bands": band, "low": low})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [K.shingles(t, width) for t in pdf["text"]]
            own = [K.set_key(s) == k for s, k in zip(sets, pdf["key"], strict=True)]  # an id may name several texts
            yield pdf[own].drop(columns="text").assign(shingles=[s.tobytes() for s, x in zip(sets, own, strict=True) if x])

    return run


def _stars(percent: int):
    """Rows sorted by (block, role), the head (role 0) first: the links of the other rows with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = head = None
        for pdf in batches:
            a, b = [], []
            for role, k, s in zip(pdf["role"], pdf["key"], pdf["shingles"], strict=True):
                s = np.frombuffer(s, np.uint64)
                if role == 0:
                    key, head = k, s
                elif K.linked(head, s, percent):
                    a.append(key)
                    b.append(k)
            yield pd.DataFrame({"a": a, "b": b})

    return run


def _settle(percent: int):
    """Runs of rows of one block: a spanning forest of the links between open rows and the chunk's rows.

    Bit 1 of role marks rows of the chunk, bit 2 open rows. Open rows are compared with rows of the chunk in
    other components; what links found here have joined is not compared again.
    """

    def forest(block: pd.DataFrame) -> pd.DataFrame:
        low = np.frombuffer(b"".join(block["low"]), np.uint8).reshape(len(block), -1)
        sets, keys = [np.frombuffer(x, np.uint64) for x in block["shingles"]], block["key"].to_numpy()
        n, comp, role = np.array([len(x) for x in sets]), pd.factorize(block["comp"])[0], block["role"].to_numpy()
        least, open_ = K.least_agreeing(2 * low.shape[1], percent), (role & 2) > 0
        chunk, out = np.flatnonzero(role & 1), []
        for i in np.flatnonzero(open_):
            # a pair of open rows of one chunk is met once, by the later of them
            j = chunk[(comp[chunk] != comp[i]) & ((chunk < i) | ~open_[chunk] | (role[i] == 2))]
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            j = j[100 * small >= percent * large]
            if not len(j):
                continue
            agree = K.agreeing(low[i], low[j])
            order = np.argsort(-agree, kind="stable")
            j = j[order[: int((agree >= least).sum())]]
            while len(j):
                if K.linked(sets[i], sets[j[0]], percent):
                    out.append((keys[i], keys[j[0]]))
                    comp[comp == comp[j[0]]] = comp[i]
                    j = j[comp[j] != comp[i]]
                else:
                    j = j[1:]
        return pd.DataFrame(out, columns=["a", "b"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            ids = pdf["block"].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1))
            yield from (forest(pdf.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True))
            held = pdf.iloc[starts[-1] :]
        if held is not None and len(held):
            yield forest(held)

    return run


def _heads(members: DataFrame) -> DataFrame:
    """(band, m, head) of ``members(band, set_key, m)``: the class whose buckets hold the most classes."""
    weight = members.groupBy("set_key").agg(F.sum("m").alias("w")).withColumnRenamed("set_key", "_key")
    weighed = members.join(weight, members["set_key"] == weight["_key"])
    return weighed.groupBy("band", "m").agg(F.max(F.struct("w", "set_key"))["set_key"].alias("head"))


def _star_links(members: DataFrame, heads: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each bucket's head with the bucket's other classes; a pair of several buckets is compared once."""
    pairs = looked_up(members.select("band", "set_key"), heads, "band", "m", "set_key").where("set_key <> head")
    pairs = staged(pairs.select(F.col("head").alias("a"), F.col("set_key").alias("b")).distinct(), "near-first")
    sizes = staged(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-first-sizes")
    pairs = looked_up(pairs, sizes, "a", "n", "b").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).alias("part"))
    full = sets.select("key", "shingles")
    members = pairs.join(full, pairs["b"] == full["key"]).select("a", "part", F.lit(1).alias("role"), "key", "shingles")
    parts = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / STAR) - 1)).alias("part"))
    heads = parts.join(full, parts["a"] == full["key"]).select("a", "part", F.lit(0).alias("role"), "key", "shingles")
    rows = members.union(heads).repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "role")
    return staged(rows.select("role", "key", "shingles").mapInPandas(_stars(percent), "a binary, b binary"), "near-links")


def _open_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(band, set_key, comp) of buckets of three classes or more, and (band, m, open, giant) of those in several components."""
    labelled = members.where("m > 2").join(labels, "set_key").select("band", "set_key", "comp")
    labelled = staged(labelled, "near-labelled")
    by = labelled.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("band").agg(F.sum("n").alias("m"), F.max(F.struct("n", "comp")).alias("most"))
    buckets = by.select("band", "m", (F.col("m") - F.col("most.n")).alias("open"), F.col("most.comp").alias("giant")).where("open > 0")
    return labelled, staged(buckets, "near-open")


def _block_links(labelled: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int, whole: bool) -> DataFrame:
    """Links that settle ``buckets``; unless ``whole``, buckets of more than BLOCK open classes are settled inside their chunks only."""
    rows = looked_up(labelled, buckets, "band", "m", "set_key")
    chunks, groups = F.ceil(F.col("m") / BLOCK).cast("int"), F.ceil(F.col("open") / BLOCK).cast("int")
    of = lambda k: F.pmod(F.xxhash64("set_key"), k).cast("int")
    is_open, many = F.col("comp") != F.col("giant"), (F.col("open") > BLOCK) & F.lit(not whole)
    role = lambda open_: F.when(open_, 3).otherwise(1)
    at = lambda group, chunk, r: F.struct(group.alias("group"), chunk.alias("chunk"), r.cast("int").alias("role"))
    rows = rows.select("band", "set_key", "comp", is_open.alias("is_open"), many.alias("many"), chunks.alias("k"), groups.alias("g"), of(chunks).alias("i"), of(groups).alias("j"))
    in_chunk = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: at(j, F.col("i"), role(F.col("is_open") & (j == F.col("j")))))
    across = F.transform(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda i: i != F.col("i")), lambda i: at(F.col("j"), i, F.lit(2)))
    alone = F.array(at(F.lit(0), F.col("i"), role(F.col("is_open"))))
    rows = rows.select("band", "set_key", "comp", F.explode(F.when(F.col("many"), alone).when(F.col("is_open"), F.concat(in_chunk, across)).otherwise(in_chunk)).alias("at"))
    rows = rows.join(sets, rows["set_key"] == sets["key"])
    rows = rows.select(F.concat_ws("/", "band", "at.group", "at.chunk").alias("block"), "at.role", "key", "comp", "low", "shingles")
    rows = rows.repartition(F.col("block")).sortWithinPartitions("block", "key")
    return staged(rows.mapInPandas(_settle(percent), "a binary, b binary").distinct(), "near-block-links")


def _joined(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """labels(set_key, comp) after ``links`` between classes; only the components that they touch are contracted."""
    ends = labels.select(F.col("set_key").alias("_key"), F.col("comp").alias("_comp"))
    found = links
    for x in "ab":
        found = found.join(ends, found[x] == ends["_key"]).withColumn(f"c{x}", F.col("_comp")).drop("_key", "_comp")
    comps = components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), name)
    joined = labels.join(comps, labels["comp"] == comps["node"], "left")
    return staged(joined.select("set_key", F.coalesce(comps["comp"], labels["comp"]).alias("comp")), f"{name}-joined")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 3], 'string_agg', ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)
), r AS (
  SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen
), c AS (
  SELECT node, min(seen) AS component_id FROM r GROUP BY node
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


def row_of(doc_id: Column, text: Column) -> Column:
    """What stands for the id of a row of null id: a hash of its text; null for rows with an id."""
    return F.when(doc_id.isNull(), F.xxhash64(text))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 4, id_col: str = "doc_id", text_col: str = "text", row: str | None = None) -> DataFrame:
    """Link documents whose shingle sets have ``100 * |A & B| >= percent * |A | B|``; one row per input row.

    Returns doc_id, n_shingles long, component_id (least doc_id reachable, itself included), kept
    boolean (doc_id = component_id). Null and empty texts, or texts of white space, have 0 shingles and
    are linked with nothing. A text of fewer than ``width`` words is one shingle. Repeated rows are
    equal copies. Rows of null id are compared and link like others, but give no component its name: in a
    component of null ids alone, component_id is null and the rows of one of its texts are kept. ``row``
    names a further column that tells rows of null id apart, see ``row_of``. Texts of any length count
    whole. An empty table gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_of(F.col(id_col), F.col(text_col)).alias("at"))
    plain = exact(docs, ["doc_id", "at"])
    kind = plain.schema["doc_id"].dataType.simpleString()
    per_doc = plain.mapInPandas(_sketched(width), f"doc_id {kind}, at string, n_shingles long, set_key binary, bands array<long>, low binary")
    per_doc = staged(restored(per_doc, docs, ["doc_id", "at"]), "near-docs")
    some = per_doc.where("n_shingles > 0")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("at").alias("rep_at"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    classes = staged(classes, "near-classes")
    members = classes.select("set_key", F.explode("bands").alias("band"))
    sizes = staged(members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "near-buckets")
    members = staged(looked_up(members, sizes, "band", "m", "set_key").select("band", "set_key", "m"), "near-members")

    # Full sets, of the classes that share a bucket.
    shared = staged(classes.select("set_key", "rep", "rep_at", "low").join(members.select("set_key").distinct(), "set_key", "left_semi"), "near-shared")
    texts = docs.join(shared, docs["doc_id"] == shared["rep"]).select(F.col("set_key").alias("key"), "low", "text")
    nameless, of_them = docs.where("doc_id is null").groupBy("at").agg(F.first("text").alias("text")), shared.where("rep is null")
    texts = texts.union(nameless.join(of_them, nameless["at"] == of_them["rep_at"]).select(F.col("set_key").alias("key"), "low", "text"))
    sets = texts.mapInPandas(_sets(width), "key binary, low binary, shingles binary").groupBy("key").agg(F.first("low").alias("low"), F.first("shingles").alias("shingles"))
    sets = staged(sets, "near-sets")

    labels = staged(shared.select("set_key", F.col("set_key").alias("comp")), "near-alone")
    labels = _joined(labels, _star_links(members, staged(_heads(members), "near-heads"), sets, percent), "near-first-components")
    labelled, buckets = _open_buckets(members, labels)
    if not buckets.isEmpty():
        labels = _joined(labels, _block_links(labelled, buckets, sets, percent, whole=False), "near-components")
        if not (many := buckets.where(F.col("open") > BLOCK)).isEmpty():
            labelled, buckets = _open_buckets(members.join(many.select("band"), "band", "left_semi"), labels)
            labels = _joined(labels, _block_links(labelled, buckets, sets, percent, whole=True), "near-last-components")

    # Classes name their components, and documents take the name of their class; classes alone in everything name themselves.
    named = classes.select("set_key", "rep", "rep_at", "n").join(labels, "set_key", "left").withColumn("comp", F.coalesce("comp", "set_key"))
    named = staged(named.where("n > 1 or comp <> set_key").unionByName(named.where("n = 1 and comp = set_key").join(labels.where("comp <> set_key").select("comp").distinct(), "comp", "left_semi")), "near-named")
    least = named.groupBy("comp").agg(F.min("rep").alias("least"), F.min("rep_at").alias("least_at"), F.count(F.lit(1)).alias("of"))
    named = looked_up(named.select("set_key", "comp", "n"), staged(least, "near-least"), "comp", "of", "set_key").select("set_key", "n", "least", "least_at", F.lit(True).alias("found"))
    out = looked_up(per_doc.select("doc_id", "at", "n_shingles", "set_key"), staged(named, "near-names"), "set_key", "n", "doc_id", how="left")
    component = F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id"))
    alone = F.col("found").isNull() | (F.col("at") == F.col("least_at"))
    kept = F.when(F.col("doc_id").isNull(), component.isNull() & alone).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *([F.col("at").alias(row)] if row else []))
