"""Exact top-k search by vector-approximation files.

Integer vectors are quantised per dimension into 256 cells, one byte a component: two cells for what lies outside the
range of a bounded sample, the others with equal shares of it, so that far-off components cost the bounds of their own
vectors only. A scan of the cells alone bounds every inner product from below and above; the k-th best lower bound of a
query is its floor. A second scan names, for every block of queries, the vectors whose upper bound reaches the floor of one of them;
only these are read exactly, and only that block's queries are compared with them. Each task reads them in the order of their bounds until its k-th result is certain and hands on k
results a query, however many vectors lie close together; the best k of all tasks are the answer.

Vectors and queries meet in blocks: packed vectors against packed queries, in one plan for all queries. Spark broadcasts
the query blocks if they are below its threshold, else each pair of partitions is a task.

Equal vectors have equal scores and ties go to the smaller id, so k + 1 ids of each distinct vector
are enough for any query; that keeps a vector with a third of all rows out of the way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, staged

#: Vectors from which a dimension's cells are cut, about; any sample gives right results.
SAMPLE = 4_096
#: Queries of a block, about; a task holds k bounds of each.
QUERIES = 8_192
#: Components of the vectors of a block.
BLOCK = 1 << 18
#: Queries that are multiplied with a block at a time.
STRIPE = 128


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def cell_bounds(sample: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cuts [width, 255], lower [width, 256], upper [width, 256]): x is in cell searchsorted(cuts, x, "right")."""
    at = np.sort(sample, axis=0)
    inner = at[np.linspace(0, len(at) - 1, 254).astype(int)]
    cuts = np.concatenate((inner, at[-1:] + 1)).T.copy()
    side = np.ones((len(cuts), 1), np.int64)
    return cuts, np.concatenate((lo * side, cuts), 1), np.concatenate((cuts - 1, hi * side), 1)


def _packed(width: int, cuts: np.ndarray | None) -> Callable:
    """Blocks of vectors: ids, row numbers and, with ``cuts``, cells, else the components of the vectors that a query block wants."""
    most = max(1, BLOCK // width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf, at in ((own, at) for own in ([whole] if cuts is not None else [g for _, g in whole.groupby("block", sort=False)]) for at in range(0, len(own), most)):
                part = pdf.iloc[at : at + most]
                x = _matrix(part["x"], width)
                if cuts is not None:
                    x = np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)
                of = {} if cuts is not None else {"block": [part["block"].iloc[0]]}
                yield pd.DataFrame(of | {"vecs": [part["vec_id"].to_numpy(np.int64).tobytes()], "rows": [part["row"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    return run


def _asked(width: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        floor = pdf["lower"].to_numpy(float, na_value=-np.inf)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["query_id"].to_numpy(np.int64).tobytes()], "q": [_matrix(pdf["q"], width).tobytes()], "floors": [floor.tobytes()]})

    return run


class _Bounds:
    """Bounds of the inner products of blocks of cells with queries."""

    def __init__(self, lower: np.ndarray, upper: np.ndarray, slack: float):
        self.lower, self.upper, self.slack = lower.astype(float), upper.astype(float), slack

    def corners(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dim = np.arange(len(self.lower))
        return self.lower[dim, cells], self.upper[dim, cells]

    def above(self, corners: tuple[np.ndarray, np.ndarray], q: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Upper bounds [row, query]; a query's own rows have none."""
        out = corners[1] @ np.clip(q, 0, None).T + corners[0] @ np.clip(q, None, 0).T + self.slack
        out[own] = -np.inf
        return out

    def below(self, corners: tuple[np.ndarray, np.ndarray], q: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = corners[0] @ np.clip(q, 0, None).T + corners[1] @ np.clip(q, None, 0).T - self.slack
        out[own] = -np.inf
        return out


def _pairs(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple]:
    """Per pair of blocks: its query block's number, ids, queries and floors, and the vectors' ids, row numbers and bytes."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            ids = np.frombuffer(r.ids, np.int64)
            yield r.block, ids, np.frombuffer(r.q, np.int64).reshape(len(ids), width), np.frombuffer(r.floors), np.frombuffer(r.vecs, np.int64), np.frombuffer(r.rows, np.int64), r.x


def _lower_bounds(bounds: _Bounds, width: int, k: int) -> Callable:
    """For each query the k best lower bounds of this task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for block, ids, q, _, vec, _, x in _pairs(batches, width):
            best = held.setdefault(block, (ids, np.full((k, len(ids)), -np.inf)))[1]
            corners = bounds.corners(np.frombuffer(x, np.uint8).reshape(len(vec), width))
            for s in range(0, len(ids), STRIPE):
                some = slice(s, s + STRIPE)
                both = np.concatenate((best[:, some], bounds.below(corners, q[some].astype(float), vec[:, None] == ids[None, some])))
                best[:, some] = np.partition(both, len(both) - k, axis=0)[-k:]
        for ids, best in held.values():
            j, i = np.nonzero(np.isfinite(best.T))
            yield pd.DataFrame({"query_id": ids[j], "lower": best[i, j]})

    return run


def _reaching(bounds: _Bounds, width: int) -> Callable:
    """(row, block): rows whose upper bound reaches the floor of some query of a block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, ids, q, floor, vec, rows, x in _pairs(batches, width):
            corners = bounds.corners(np.frombuffer(x, np.uint8).reshape(len(vec), width))
            hit = np.zeros(len(vec), bool)
            for s in range(0, len(ids), STRIPE):
                some = slice(s, s + STRIPE)
                above = bounds.above(corners, q[some].astype(float), vec[:, None] == ids[None, some])
                hit |= ((above >= floor[some]) & (above > -np.inf)).any(1)
            yield pd.DataFrame({"row": rows[hit], "block": np.int32(block)})

    return run


def _exact(bounds: _Bounds, cuts: np.ndarray, width: int, k: int, chunk: int = 256) -> Callable:
    """The k best of this task for each query, exactly: vectors in the order of their bounds, as far as they can matter."""
    kind = np.int64 if bounds.slack else float  # products of doubles are exact below 2 ** 53

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, list]] = {}
        for block, ids, q, floor, vec, _, x in _pairs(batches, width):
            best = held.setdefault(block, (ids, [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)))[1]
            x = np.frombuffer(x, np.int64).reshape(len(vec), width)
            corners = bounds.corners(np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], 1))
            x, q = x.astype(kind), q.astype(kind)
            for s in range(0, len(ids), STRIPE):
                some = slice(s, s + STRIPE)
                upper = bounds.above(corners, q[some].astype(float), vec[:, None] == ids[None, some])
                for j in range(upper.shape[1]):
                    score, name = best[s + j]
                    least = max(floor[s + j], score[-1] if len(score) == k else -np.inf)
                    near = np.flatnonzero((upper[:, j] >= least) & (upper[:, j] > -np.inf))
                    near = near[np.argsort(-upper[near, j], kind="stable")]
                    for c in range(0, len(near), chunk):
                        if len(score) == k and upper[near[c], j] < score[-1]:
                            break
                        now = near[c : c + chunk]
                        score, name = np.concatenate((score, (x[now] @ q[s + j]).astype(np.int64))), np.concatenate((name, vec[now]))
                        first = np.lexsort((name, -score))[:k]
                        score, name = score[first], name[first]
                    best[s + j] = score, name
        for ids, best in held.values():
            n = [len(v) for v, _ in best]
            yield pd.DataFrame({"query_id": np.repeat(ids, n), "vec_id": np.concatenate([i for _, i in best]), "score": np.concatenate([v for v, _ in best])})

    return run


def search(vectors: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for every row whose id is divisible by ``query_every``.

    Components become floor(scale * x). Returns query_id, rank int from 1, vec_id, score long; ties go to
    the smaller vec_id; fewer than k candidates give all of them. Rows of the query's id are its own and
    never candidates. Null ids, null vectors and vectors with null or non-finite components take no
    part; shorter vectors count as padded with zeros. Rows repeated with id and vector are one candidate;
    queries of one id are one query (of the least vector, if they differ). Scores are exact as long as they are
    below 2 ** 63. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    e = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(e, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).distinct()
    rows = staged(rows.withColumn("of", F.xxhash64("x")), "topk-vectors")
    least = rows.agg(F.min(F.array_min("x")), F.max(F.array_max("x")), F.max(F.size("x")), F.count(F.lit(1))).first()
    asked = rows.where(F.col("vec_id") % query_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("q"))
    asked = staged(asked, "topk-asked")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lo, hi, width = min(least[0] or 0, 0), max(least[1] or 0, 0), max(1, least[2])  # padding is within the cells
    every = max(1, least[3] // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(every)) == 0).select("x").collect() or rows.select("x").limit(1).collect()
    cuts, lower, upper = cell_bounds(_matrix(pd.Series([r["x"] for r in sample]), width), lo, hi)
    largest = width * max(-lo, hi) ** 2
    bounds = _Bounds(lower, upper, 0.0 if largest < 1 << 53 else float(largest) * width * 2.0**-50)

    # k + 1 smallest ids of each distinct vector, by salted and then by whole groups.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(32))
    for keys in (["of", "x", salt], ["of", "x"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("_n") <= k + 1).drop("_n")
    rows = staged(rows.select("vec_id", "x", F.monotonically_increasing_id().alias("row")), "topk-rows")
    packed = "vecs binary, rows binary, x binary"
    cells = staged(rows.mapInPandas(_packed(width, cuts), packed), "topk-cells")

    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(-(-n_asked // QUERIES))).cast("int"))
    blocks = lambda df: staged(df.groupBy("block").applyInPandas(_asked(width), "block int, ids binary, q binary, floors binary"), "topk-queries")
    queries = blocks(asked.withColumn("lower", F.lit(None).cast("double")))
    found = staged(cells.crossJoin(queries).mapInPandas(_lower_bounds(bounds, width, k), "query_id long, lower double"), "topk-bounds")
    floors = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))).where(F.col("_n") == k).select("query_id", "lower")
    queries = blocks(asked.join(floors, "query_id", "left"))
    # A vector is read for the query blocks that named it and meets no others.
    named = staged(cells.crossJoin(queries).mapInPandas(_reaching(bounds, width), "row long, block int"), "topk-named")
    asked_for = rows.join(named, "row").repartition("block", F.pmod(F.xxhash64("row"), F.lit(8 * partitions(spark))))
    read = staged(asked_for.select("block", "vec_id", "row", "x").mapInPandas(_packed(width, None), f"block int, {packed}"), "topk-read")
    found = staged(read.join(queries, "block").mapInPandas(_exact(bounds, cuts, width, k), "query_id long, vec_id long, score long"), "topk-found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
