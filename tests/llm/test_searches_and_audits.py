"""Vantage-point search, source divergence and filter interaction against plain definitions, and on awkward rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampflow.llm import divergence, filters, vptree

SF = "/root/testdata/sf0.001"


# Vantage-point trees ------------------------------------------------------------------------------


def clustered(n, width, seed, clusters=12):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, width))


def plain(table, k, every):
    """{query: [(vec_id, score)]} by all products."""
    out = {}
    for i, q in table:
        if i % every == 0:
            scores = [(-float(vptree.scores(v[None], q[None])[0]), j) for j, v in table if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


@pytest.mark.parametrize("width", [3, 24])
def test_factor_one_is_exact(spark, monkeypatch, width):
    """Many regions, shards and leaves, vectors of different lengths, and copies: the same as all products."""
    monkeypatch.setattr(vptree, "SHARD", 60 * width)
    monkeypatch.setattr(vptree, "SAMPLE", 200)
    monkeypatch.setattr(vptree, "LEAF", 8)
    x = clustered(700, width, 1) * np.linspace(0.2, 3, 700)[:, None]
    x[100:130] = x[5]
    table = list(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in table], "vec_id long, embedding array<double>")
    got = found(vptree.search(df, k=7, query_every=20, relax=1.0))
    assert got == plain(table, 7, 20)


@pytest.mark.parametrize(("width", "clusters"), [(48, 40), (16, 40), (48, 4)])
def test_relaxed_search_finds_most(spark, width, clusters):
    x = clustered(3000, width, 2, clusters)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(vptree.search(df, k=20, query_every=20)), plain(list(enumerate(x)), 20, 20)
    hits = [len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want]
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values()) and sum(hits) >= 0.95 * 20 * len(want)


def test_recall_of_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    table = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    got, want = found(vptree.search(df)), plain(table, 20, 20)
    assert sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want) >= 0.95 * 20 * len(want)


def test_leaves_prune_and_bounds_hold():
    """Bounds are never above the true distance, and near one leaf the others are mostly out of reach."""
    x = clustered(2000, 6, 3)
    tree = vptree.grow(x, 32)
    assert sorted(tree.order.tolist()) == list(range(2000)) and np.diff([*tree.starts, 2000]).max() <= 32
    d = vptree.distances(x[tree.order], tree.points)
    lo, hi = np.minimum.reduceat(d, tree.starts), np.maximum.reduceat(d, tree.starts)
    q = clustered(2000, 6, 3)[:50] + 0.05
    least = vptree.bounds(vptree.distances(q, tree.points), lo, hi)
    far = vptree.distances(q, x[tree.order])
    true = np.minimum.reduceat(far, tree.starts, axis=1)
    assert (least <= true + 1e-9).all()
    kth = np.sort(far, 1)[:, 9:10]
    assert (least <= kth).mean() < 0.5


def test_search_depends_on_no_block(spark, monkeypatch):
    x = clustered(900, 8, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = found(vptree.search(df, k=5))
    monkeypatch.setattr(vptree, "BLOCK", 16)
    assert found(vptree.search(df.repartition(7), k=5)) == whole


def test_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [2.0]), (8, [0.0, 0.0]), (20, [1.0, 0.0]), (2, [0.5, 0.5]), (40, [-1.0, 0.0]), (60, [float("inf"), 1.0])]
    v = spark.createDataFrame([(*r, 1, "s", 2, 3.0) for r in rows], "vec_id long, embedding array<double>, score int, region string, salt int, of double")
    got = found(vptree.search(v, k=3))
    assert got == {0: [(7, 2.0), (20, 1.0), (1, 0.5)], 20: [(7, 2.0), (0, 1.0), (1, 0.5)], 40: [(1, -0.5), (2, -0.5), (0, -1.0)]}
    assert vptree.search(v.limit(0)).collect() == [] and vptree.search(v.where("vec_id = 1")).collect() == []
    assert vptree.search(v.where("vec_id = 0")).collect() == [] and vptree.search(v.where("vec_id = 8")).collect() == []
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(200)], "vec_id long, embedding array<float>")
    got = found(vptree.search(same, k=3))
    assert got[0] == [(1, 2.0), (2, 2.0), (3, 2.0)] and got[20] == [(0, 2.0), (1, 2.0), (2, 2.0)] and len(got) == 10


# Divergence ---------------------------------------------------------------------------------------


def plain_divergence(rows, least=10, top=10):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        whole = Counter(t for d in mine for t in d[2])
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, o, -v, i) for part, ranked in (("pair", pairs), ("term", terms)) for i, (v, _, o) in enumerate(ranked, 1)}
    return out


def divergences(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, n long, place int, term string")
    got = [tuple(r) for r in divergence.audit_sources(docs.repartition(3), **options).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


def awkward_texts(n=160, seed=7, sources=6):
    rng = np.random.default_rng(seed)
    words = ["Ab", "ab", "öl", "ÖL", "x1y", "don't", "café", "日本", "ﬂ", "a_b", "É", "z", "Straße", "k\x7fm", "q\x00r"]
    out = [(" ".join(rng.choice(words, rng.integers(0, 25), p=np.arange(15, 0, -1) / 120)), ("en", "de", None, "")[rng.integers(4)], f"s{rng.integers(sources)}") for _ in range(n)]
    return [*out, (None, "en", "s0"), ("", "de", None), ("", "fr", "alone"), (None, None, None), ("zz " * 30, "en", "Sé"), *out[:9]]


@pytest.mark.parametrize("block", [2, 3, 128])
def test_divergence_by_definition(spark, monkeypatch, block):
    """Also with blocks smaller than the number of sources, few counts a block and few entries a task."""
    rows = awkward_texts()
    want = plain_divergence(rows)
    for name, value in (("BLOCK", block), ("TABLES", 2), ("SHARES", 3), ("COUNTED", 9), ("PAIRS", 8)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "STRETCH", 5)
    # The names are read on the driver and in tasks; tasks get the functions as they are here.
    for f in ("_counted", "_both", "_one", "_stretches", "between"):
        getattr(divergence, f).__module__ = "__main__"
    try:
        assert divergences(spark, rows) == want
    finally:
        for f in ("_counted", "_both", "_one", "_stretches", "between"):
            getattr(divergence, f).__module__ = divergence.__name__


def test_divergence_without_kept_terms_and_without_rows(spark):
    rows = [("a b", "en", "s"), ("c", "en", "t"), (None, "en", "u"), ("d", "de", "s")]
    got = divergences(spark, rows)
    assert got == plain_divergence(rows) and {(r[3], r[4]) for r in got if r[1] == "s"} == {("t", 0), ("u", 0)}
    assert divergences(spark, rows[:1]) == set()
    assert divergence.audit_sources(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_divergence_of_a_very_long_text(spark):
    rows = [("word " * 400_000 + "other", "en", "long"), *[("word other more", "en", f"s{i % 3}") for i in range(30)]]
    assert divergences(spark, rows) == plain_divergence(rows)


def test_divergence_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    got = {tuple(r) for r in divergence.audit_sources(docs).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == plain_divergence(rows)


# Filters ------------------------------------------------------------------------------------------


def plain_filters(docs, labels):
    """Every order applied filter by filter, document by document."""
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, quality, bad in labels:
        good |= {i} if quality == 1 and i is not None else set()
        toxic |= {i} if bad == 1 and i is not None else set()

    def failing(i, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and text in first and i > first[text])
        return {f for f, t in zip("ABCDE", tests, strict=True) if t}

    parts = defaultdict(list)
    for i, text, lang in docs:
        parts[lang or ""].append((i, failing(i, text or "")))
    out = set()
    for part, rows in parts.items():
        steps, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                every = sum(f in r[1] for r in rows)
                shapley[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), every - len(gone), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)))
        out |= {(*s, shapley[s[1][s[2] - 1]]) for s in steps}
    return out


NAMES = ("part", "filter_order", "step", *filters.COUNTS, "shapley")


def test_filters_by_definition(spark):
    rng = np.random.default_rng(3)
    words = [*"abcdefghij", "KLM", "50%", "née", "A&B"]
    docs = [(int(i), " ".join(rng.choice(words if i % 2 else [f"w{j}" for j in range(400)] + words, rng.choice([3, 99, 100, 150]))), (None, "", "en", "de")[i % 4]) for i in range(60)]
    long = " ".join(f"w{i}" for i in range(50_000))
    docs += [(100, docs[3][1], "de"), (2, docs[3][1], "en"), (101, None, "en"), (102, "", "de"), (None, docs[3][1], "en"), (None, None, None), (None, "#", "en"), (103, long, "en"), (104, long, "en"), docs[5], docs[5]]
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 110, 2)] + [(4, 1, 0), (4, None, None), (None, 1, 1)]
    d = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, lang string, n long, digest string, fails int").repartition(3)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r[c] for c in NAMES) for r in filters.audit_filters(d, marks).collect()]
    assert len(got) == 600 * 3 and set(got) == plain_filters(docs, labels)
    assert filters.audit_filters(d.limit(0), marks).collect() == []
    assert {r[7:9] for r in (tuple(r[c] for c in NAMES) for r in filters.audit_filters(d, marks.limit(0)).collect())} == {(0, 0)}


def test_paths_conserve_documents(spark):
    """On every path what is kept and removed adds up, and the shares of the filters are 120 times what all of them remove."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = filters.audit_filters(docs, labels).cache()
    n = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    for r in out.groupBy("part", "filter_order").agg(F.sum("removed").alias("gone"), F.min("kept").alias("left")).collect():
        assert r["gone"] + r["left"] == n[r["part"]]
    for r in out.where("step = 5").groupBy("part").agg(F.first("kept").alias("left")).collect():
        total = out.where(F.col("part") == r["part"]).selectExpr("substring(filter_order, step, 1) AS f", "shapley").distinct().agg(F.sum("shapley")).first()[0]
        assert total == 120 * (n[r["part"]] - r["left"])
