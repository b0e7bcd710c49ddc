"""Approximate nearest neighbours by vantage-point trees, one a shard, with relaxed triangle-inequality pruning.

Largest inner product is smallest distance once every vector gets one more component that brings all of them to the
same length; queries get 0 there. In that space a leaf whose vectors lie at distances lo to hi from a vantage point
holds nothing nearer to a query at distance d of that point than max(lo - d, d - hi). A leaf is read unless ``relax``
times that bound is beyond the query's kth distance so far: 1 is exact search, more is faster and may miss some.

A small tree over a bounded sample deals all vectors into regions, and each region by hash into shards of bounded size, so
that a dense region is many shards. Every shard's tree is one row. A query first searches one shard of its own region;
what it finds there prunes whole regions, and only the shards of the others get the query, in blocks of queries.

Vantage points are means of vectors that lie close together and a split is where distances leave the widest gap, so
that a ball holds a cluster. Equal vectors have equal scores and ties go to the smaller id, so k + 1 ids of each
distinct vector are enough for any query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, staged

#: Vectors from which the regions are cut, about, and most regions; any sample gives complete results.
SAMPLE, REGIONS = 4_096, 64
#: Components of the vectors of a shard, about, and vectors of a leaf.
SHARD, LEAF = 1 << 19, 64
#: Components of the queries of a block, about.
BLOCK = 1 << 15
#: Relative error of a bound in double precision, by far.
SLACK = 1e-9


@dataclass
class Tree:
    """Vantage points; per inner node (radius, child, child), a child below 0 being leaf -1 - child; rows by leaf; first row of each leaf."""

    points: np.ndarray
    nodes: list[tuple[float, int, int]]
    order: np.ndarray
    starts: np.ndarray


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def _vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Of some means of close vectors, the one whose distances differ most."""
    some = x[np.sort(rng.choice(len(x), min(512, len(x)), replace=False))]
    at = some[rng.choice(len(some), min(16, len(some)), replace=False)]
    few = max(1, len(some) // 16)
    for _ in range(2):
        at = some[np.argpartition(distances(at, some), few - 1, axis=1)[:, :few]].mean(1)
    return at[np.argmax(distances(at, some).var(1))]


def _cut(d: np.ndarray) -> int:
    """Where sorted distances leave the widest gap, a sixteenth of them or more on either side."""
    n = len(d)
    wide = max(1, n // 64)
    lo, hi = n // 16, n - n // 16 - wide
    gaps = d[lo + wide : hi + wide] - d[lo:hi]
    return min(max(lo + int(np.argmax(gaps)) + (wide + 1) // 2, 1), n - 1) if len(gaps) else n // 2


def grow(x: np.ndarray, leaf: int, seed: int = 0) -> Tree:
    """A tree whose leaves have ``leaf`` rows at most. The same rows in the same order give the same tree."""
    rng = np.random.default_rng(seed)
    points, nodes, rows, starts, at = [], [], [], [], 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        part, parent, side = todo.pop()
        if len(part) <= leaf:
            me = -1 - len(starts)
            rows.append(part)
            starts.append(at)
            at += len(part)
        else:
            me = len(nodes)
            points.append(_vantage(x[part], rng))
            d = distances(x[part], points[-1][None])[:, 0]
            near = np.argsort(d, kind="stable")
            m = _cut(d[near])
            nodes.append([float(d[near[m - 1]] + d[near[m]]) / 2, 0, 0])
            todo += [(part[near[m:]], me, 2), (part[near[:m]], me, 1)]
        if parent >= 0:
            nodes[parent][side] = me
    return Tree(np.array(points).reshape(len(points), x.shape[1]), [tuple(n) for n in nodes], np.concatenate(rows), np.array(starts))


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf whose ball each row falls into."""
    out, todo = np.zeros(len(x), np.int64), [(0 if tree.nodes else -1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
        elif len(rows):
            radius, inside, outside = tree.nodes[node]
            near = distances(x[rows], tree.points[node][None])[:, 0] <= radius
            todo += [(inside, rows[near]), (outside, rows[~near])]
    return out


def bounds(d: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance [query, leaf], by distances [query, point] and intervals [leaf, point]."""
    out = np.zeros((len(d), len(lo)))
    for p in range(d.shape[1]):
        np.maximum(out, lo[:, p] - d[:, p, None], out=out)
        np.maximum(out, d[:, p, None] - hi[:, p], out=out)
    return out


@dataclass
class Space:
    """Vectors of ``width`` components, divided by ``unit`` and brought to length ``longest`` by one component more."""

    width: int
    unit: float
    longest: float

    def matrix(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.unit
        return np.column_stack((x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))))

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q / self.unit, np.zeros(len(q))))

    def distance(self, score: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Distances at which vectors have these scores."""
        q = q / self.unit
        return np.sqrt(np.maximum((q * q).sum(1) + self.longest**2 - 2 * score / self.unit**2, 0))


def scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed in the order of its components."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * q[:, d]
    return out


def _shard(space: Space, regions: Tree) -> Callable:
    """A shard's tree as one row: vectors by leaf, vantage points, intervals of the leaves and of the whole shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x, ids = space.matrix(pdf["x"]), pdf["vec_id"].to_numpy(np.int64)
        lifted = space.lifted(x)
        tree = grow(lifted, LEAF, seed=1)
        d = distances(lifted[tree.order], tree.points)
        far = distances(lifted, regions.points)
        made = {"vecs": ids[tree.order], "x": x[tree.order], "starts": tree.starts, "points": tree.points, "lo": np.minimum.reduceat(d, tree.starts), "hi": np.maximum.reduceat(d, tree.starts)}
        key = pdf[["region", "salt"]].iloc[:1].reset_index(drop=True)
        return key.assign(**{k: [v.tobytes()] for k, v in made.items()}, nearest=[far.min(0).tolist()], farthest=[far.max(0).tolist()])

    return run


_SHARD = "region int, salt int, vecs binary, x binary, starts binary, points binary, lo binary, hi binary, nearest array<double>, farthest array<double>"


def nearest(space: Space, k: int, relax: float, shard, ids: np.ndarray, q: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, vector's id, score) of the k best of a shard for each query, as far as they reach its floor.

    A query reads its likeliest leaf first and the others in the shard's order, so that what it finds does not depend on
    the queries beside it.
    """
    vecs, starts = np.frombuffer(shard.vecs, np.int64), np.frombuffer(shard.starts, np.int64)
    ends = np.append(starts[1:], len(vecs))
    x = np.frombuffer(shard.x).reshape(len(vecs), space.width)
    points = np.frombuffer(shard.points).reshape(-1, space.width + 1)
    lo, hi = (np.frombuffer(b).reshape(len(starts), len(points)) for b in (shard.lo, shard.hi))
    least = bounds(distances(space.asked(q), points), lo, hi)
    first = least.argmin(1)
    error = SLACK * max(1.0, float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * space.width)
    best = np.full((len(q), k), -np.inf)
    edge = floor.copy()  # score below which nothing matters
    found = []

    def read(leaf: int, who: np.ndarray) -> None:
        rows = slice(starts[leaf], ends[leaf])
        s = q[who] @ x[rows].T
        s[ids[who, None] == vecs[rows]] = -np.inf
        both = np.concatenate((best[who], s), 1)
        best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        edge[who] = np.maximum(floor[who], best[who].min(1))
        i, j = np.nonzero((s >= edge[who, None] - error) & (s > -np.inf))
        found.append((who[i], starts[leaf] + j, s[i, j]))

    for leaf in np.unique(first):
        read(leaf, np.flatnonzero(first == leaf))
    for leaf in range(len(starts)):
        beyond = np.full(len(q), np.inf)
        some = edge > -np.inf
        beyond[some] = space.distance(edge[some], q[some])
        who = np.flatnonzero((first != leaf) & (relax * least[:, leaf] <= beyond * (1 + SLACK) + SLACK))
        if len(who):
            read(leaf, who)
    who, row, near = (np.concatenate(c) for c in zip(*found, strict=True))
    some = near >= edge[who] - error
    who, row = who[some], row[some]
    exact = scores(x[row], q[who])
    some = exact >= floor[who]
    who, name, exact = who[some], vecs[row[some]], exact[some]
    by = np.lexsort((name, -exact, who))
    who, name, exact = who[by], name[by], exact[by]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    return who[place < k], name[place < k], exact[place < k]


def _searched(space: Space, k: int, relax: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids = np.frombuffer(r.ids, np.int64)
                who, name, score = nearest(space, k, relax, r, ids, np.frombuffer(r.q).reshape(len(ids), space.width), np.frombuffer(r.floors))
                yield pd.DataFrame({"query_id": ids[who], "vec_id": name, "score": score})

    return run


def _blocked(space: Space) -> Callable:
    """Queries of one shard as blocks of a bounded size."""
    most = max(1, BLOCK // space.width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (region, salt), own in pdf.groupby(["region", "salt"], sort=False):
                for at in range(0, len(own), most):
                    some = own.iloc[at : at + most]
                    floor = some["floor"].to_numpy(float, na_value=-np.inf)
                    yield pd.DataFrame({"region": [region], "salt": [salt], "ids": [some["query_id"].to_numpy(np.int64).tobytes()], "q": [space.matrix(some["q"]).tobytes()], "floors": [floor.tobytes()]})

    return run


def search(vectors: DataFrame, k: int = 20, query_every: int = 20, relax: float = 1.25, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows found of largest inner product for every row whose id is divisible by ``query_every``.

    Returns query_id, rank int from 1, vec_id, score double (the inner product of the vectors as they are, summed in the
    order of their components); nearest first, ties to the smaller vec_id; fewer than k candidates give all of them. With
    ``relax`` 1 the result is exact, above it some of the k may be missed (see the README for measured recall).

    Rows of the query's id are its own and never candidates. Null ids, null, empty and zero vectors and vectors with null or
    non-finite components take no part; shorter vectors count as padded with zeros. Rows repeated with id and vector
    are one candidate; queries of one id are one query (of the least vector, if they differ). An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    e = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0)
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(e, lambda c: c.cast("double")).alias("x")).distinct()
    rows = staged(rows.withColumn("of", F.xxhash64("x")), "vp-vectors")
    largest = F.max(F.array_max(F.transform("x", lambda c: F.abs(c))))
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("q"))
    n, width, unit = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), largest).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    squares = F.aggregate("x", F.lit(0.0), lambda s, c: s + (c / unit) * (c / unit))
    space = Space(width, unit, float(rows.agg(F.max(squares)).first()[0] ** 0.5))

    # k + 1 smallest ids of each distinct vector, by salted and then by whole groups.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    kept = rows
    for keys in (["of", "x", salt], ["of", "x"]):
        kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n")

    every = max(1, n // SAMPLE)
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(every)) == 0).sort("vec_id", "x").limit(4 * SAMPLE).collect() or rows.limit(1).collect()
    sample = space.lifted(space.matrix([r["x"] for r in drawn]))
    each = max(1, SHARD // width)
    regions = grow(sample, max(1, -(-len(sample) // min(REGIONS, -(-n // each)))))

    def dealt(key: str, column: str, lift) -> Callable:
        def run(batches):
            for pdf in batches:
                yield pdf.assign(region=leaf_of(regions, lift(space.matrix(pdf[column]))).astype(np.int32))[[key, column, "region"]]

        return run

    kept = staged(kept.select("vec_id", "x").mapInPandas(dealt("vec_id", "x", space.lifted), "vec_id long, x array<double>, region int"), "vp-regions")
    sizes = {r["region"]: -(-r["n"] // each) for r in kept.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a region
    salts = spark.createDataFrame(list(sizes.items()), "region int, salts long")
    kept = kept.join(F.broadcast(salts), "region").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    index = staged(kept.select("region", "salt", "vec_id", "x").groupBy("region", "salt").applyInPandas(_shard(space, regions), _SHARD), "vp-index")
    spans = index.select("region", F.posexplode(F.arrays_zip("nearest", "farthest")).alias("p", "d")).groupBy("region", "p").agg(F.min("d.nearest").alias("lo"), F.max("d.farthest").alias("hi"))
    lo, hi = np.full((max(sizes) + 1, len(regions.points)), np.inf), np.full((max(sizes) + 1, len(regions.points)), -np.inf)
    for r in spans.collect():  # at most REGIONS squared, about
        lo[r["region"], r["p"]], hi[r["region"], r["p"]] = r["lo"], r["hi"]
    there = np.isin(np.arange(len(lo)), list(sizes))

    # A query's own region, or the one of the least bound where that is empty.
    def at_home(batches):
        for pdf in batches:
            q = space.asked(space.matrix(pdf["q"]))
            least = np.where(there, bounds(distances(q, regions.points), lo, hi), np.inf)
            home = leaf_of(regions, space.lifted(space.matrix(pdf["q"])))
            home = np.where(np.isin(home, np.flatnonzero(there)), home, least.argmin(1))
            yield pdf.assign(region=home.astype(np.int32))[["query_id", "q", "region"]]

    def routed(batches):
        for pdf in batches:
            x = space.matrix(pdf["q"])
            least = np.where(there, bounds(distances(space.asked(x), regions.points), lo, hi), np.inf)
            floor = pdf["floor"].to_numpy(float, na_value=-np.inf)
            beyond = np.full(len(x), np.finfo(float).max)
            some = floor > -np.inf
            beyond[some] = space.distance(floor[some], x[some])
            i, region = np.nonzero(relax * least <= beyond[:, None] * (1 + SLACK) + SLACK)
            yield pdf.iloc[i].assign(to=region.astype(np.int32))[["query_id", "q", "floor", "region", "to"]]

    def found_in(queries: DataFrame, name: str) -> DataFrame:
        own = queries.select("region", "salt", "query_id", "q", "floor").repartition("region", "salt", F.pmod(F.xxhash64("query_id"), F.lit(8)))
        blocks = staged(own.mapInPandas(_blocked(space), "region int, salt int, ids binary, q binary, floors binary"), f"{name}-queries")
        met = blocks.join(index.drop("nearest", "farthest"), ["region", "salt"])
        return staged(met.mapInPandas(_searched(space, k, relax), "query_id long, vec_id long, score double"), name)

    asked = staged(asked.mapInPandas(at_home, "query_id long, q array<double>, region int"), "vp-asked")
    near = found_in(asked.select("*", F.lit(0).alias("salt"), F.lit(None).cast("double").alias("floor")), "vp-home")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == k).select("query_id", F.col("score").alias("floor"))
    ways = asked.join(floors, "query_id", "left").select("query_id", "q", "floor", "region").mapInPandas(routed, "query_id long, q array<double>, floor double, region int, to int")
    ways = ways.join(F.broadcast(salts.withColumnRenamed("region", "to")), "to").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int"))))
    ways = ways.where((F.col("to") != F.col("region")) | (F.col("salt") > 0)).select(F.col("to").alias("region"), "salt", "query_id", "q", "floor")
    found = near.unionByName(found_in(ways, "vp-rest"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
