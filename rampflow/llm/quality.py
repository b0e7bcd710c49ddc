"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees to one feature at a time, in turn and with a small rate; a feature's
trees add up to a look-up table over its bins. The pairs of features that explain most of what is left
get tables of two dimensions in the same way. A score is the sum of a few table cells: bins are
found by binary search for whole columns at once and the cells are added as vectors.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact, restored, small_batches

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line break, 6 sentence mark, 7 other mark, 8 UTF-8 lead or tail.
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 32]] = 4
_CLASS[[10, 13]] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[128:] = 8

FEATURES = (
    "log_words",
    "word_length",
    "long_words",
    "short_words",
    "upper",
    "digits",
    "sentence_marks",
    "other_marks",
    "spaces",
    "breaks",
    "wide",
    "distinct_words",
    "top_word",
    "distinct_lines",
    "longest_line",
    "line_words",
    "sentence_words",
    "marked_words",
    "doubled_marks",
    "compression",
    "capital_words",
    "runs",
)


def features(text: str | None) -> list[float]:
    """Figures of the whole text, in the order of FEATURES; the empty text has zeros."""
    b = (text or "").encode()
    w = b.split()
    if not w:
        return [0.0] * len(FEATURES)
    n, size = len(w), len(b)
    codes = np.frombuffer(b, np.uint8)
    kind = _CLASS[codes]
    share = np.bincount(kind, minlength=9) / size
    lengths = np.fromiter(map(len, w), np.int64, n)
    seen: dict[bytes, int] = {}
    for x in w:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in b.split(b"\n") if x.strip()]
    marks = kind >= 6
    marks &= kind <= 7
    same = codes[1:] == codes[:-1]
    sentences = b.count(b". ") + b.count(b".\n") + b.count(b"! ") + b.count(b"? ") + 1
    ends = _CLASS[np.fromiter((x[-1] for x in w), np.uint8, n)]
    starts = _CLASS[np.fromiter((x[0] for x in w), np.uint8, n)]
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 15).mean()),
        float((lengths <= 3).mean()),
        float(share[2]),
        float(share[3]),
        float(share[6]),
        float(share[7]),
        float(share[4]),
        float(share[5]),
        float(share[8]),
        float(np.log1p(len(seen)) / np.log1p(n)),
        max(seen.values()) / n,
        len(set(lines)) / len(lines),
        max(map(len, lines)) / size,
        float(np.log1p(n / len(lines))),
        float(np.log1p(n / sentences)),
        float(((ends == 7) | (starts == 7)).mean()),
        float((same & marks[1:]).sum() / size),
        len(zlib.compress(b, 1)) / (size + 40),
        float((starts == 2).mean()),
        float((same[1:] & same[:-1]).sum() / size) if size > 2 else 0.0,
    ]


@dataclass
class Model:
    start: float
    edges: list[np.ndarray]  # per feature, upper edges of its bins
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]  # coarser edges for pairs
    pair_tables: list[np.ndarray]


def _leaf(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    return g / (h + penalty)


def _split(g: np.ndarray, h: np.ndarray, penalty: float) -> int:
    """The best place to cut a row of bins: bins up to it go left; -1 if no cut gains."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return -1
    gain = gl**2 / (hl + penalty) + (g.sum() - gl) ** 2 / (h.sum() - hl + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    best = int(gain.argmax())
    return best if gain[best] > 1e-9 else -1


def _tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """A tree of at most four leaves over the bins of a feature, as a table."""
    out = np.zeros(len(g))
    cut = _split(g, h, penalty)
    for side in (slice(0, cut + 1), slice(cut + 1, None)) if cut >= 0 else (slice(0, None),):
        gs, hs = g[side], h[side]
        inner = _split(gs, hs, penalty)
        values = np.full(len(gs), _leaf(gs.sum(), hs.sum(), penalty))
        if inner >= 0:
            values[: inner + 1] = _leaf(gs[: inner + 1].sum(), hs[: inner + 1].sum(), penalty)
            values[inner + 1 :] = _leaf(gs[inner + 1 :].sum(), hs[inner + 1 :].sum(), penalty)
        out[side] = values
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """The best cut of both features of a pair into four leaves, as a table."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
    for a, b in ((cg[:-1, :-1], ch[:-1, :-1]), (cg[:-1, -1:] - cg[:-1, :-1], ch[:-1, -1:] - ch[:-1, :-1]), (cg[-1:, :-1] - cg[:-1, :-1], ch[-1:, :-1] - ch[:-1, :-1]), (tg - cg[:-1, -1:] - cg[-1:, :-1] + cg[:-1, :-1], th - ch[:-1, -1:] - ch[-1:, :-1] + ch[:-1, :-1])):
        gain += a**2 / (b + penalty)
    out = np.zeros_like(g)
    if not gain.size:
        return out
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    for r in (slice(0, i + 1), slice(i + 1, None)):
        for c in (slice(0, j + 1), slice(j + 1, None)):
            out[r, c] = _leaf(g[r, c].sum(), h[r, c].sum(), penalty)
    return out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.1, pairs: int = 8, pair_bins: int = 12, penalty: float = 2.0) -> Model:
    """Fit the model to rows ``x`` and 0/1 labels ``y``; everything is determined by its arguments."""
    n, width = x.shape
    edges = [_edges(x[:, f], bins) for f in range(width)]
    at = [np.searchsorted(edges[f], x[:, f]) for f in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    mean = (y.sum() + 1) / (n + 2)
    start = float(np.log(mean / (1 - mean)))
    z = np.full(n, start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(width):
            g, h = slopes()
            size = len(tables[f])
            t = rate * _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), penalty)
            tables[f] += t
            z += t[at[f]]

    coarse = [_edges(x[:, f], pair_bins) for f in range(width)]
    in_pair = [np.searchsorted(coarse[f], x[:, f]) for f in range(width)]
    g, h = slopes()
    gains = []
    for a, b in itertools.combinations(range(width), 2):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        cell = in_pair[a] * shape[1] + in_pair[b]
        gs, hs = np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)
        t = _quadrants(gs, hs, penalty)
        gains.append((float((t * gs).sum()), (a, b)))
    chosen = [p for _, p in sorted(gains, key=lambda v: (-v[0], v[1]))[:pairs]]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(rounds // 2):
        for k, (a, b) in enumerate(chosen):
            g, h = slopes()
            shape = pair_tables[k].shape
            cell = in_pair[a] * shape[1] + in_pair[b]
            t = rate * _quadrants(np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), penalty)
            pair_tables[k] += t
            z += t.ravel()[cell]
    return Model(start, edges, tables, chosen, coarse, pair_tables)


def score(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of ``x``."""
    z = np.full(len(x), model.start)
    for f, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)):
        z += t[np.searchsorted(e, x[:, f])]
    for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
        z += t[np.searchsorted(model.pair_edges[a], x[:, a]), np.searchsorted(model.pair_edges[b], x[:, b])]
    return 1 / (1 + np.exp(-z))


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["label"], "place": pdf["place"], "x": [features(t if isinstance(t, str) else None) for t in pdf["text"]]})


def _scored(model, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([features(t if isinstance(t, str) else None) for t in pdf["text"]]).reshape(len(pdf), len(FEATURES))
            p = score(model.value, x)
            yield pdf.drop(columns="text").assign(score=p, predicted=(p >= threshold).astype(np.int32))

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int) -> Model:
    """Fit to about ``rows`` labelled documents that are not held out, chosen by id hash; the features of at most about that many reach the driver."""
    labels = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
    every = max(1, round(labels.count() / rows))
    place = F.xxhash64(F.col("label_id").cast("string"))
    chosen = labels.where(F.pmod(place, F.lit(every)) == 0).distinct().withColumn("place", place)
    if every == 1 or chosen.count() <= 2 * rows:  # some 20 bytes a row
        chosen = F.broadcast(chosen)
    texts = docs.join(chosen, docs["doc_id"] == chosen["label_id"]).groupBy("label", "place").agg(F.min("text").alias("text"))  # one text an id, however often it is there
    found = sorted((r["place"], r["label"], r["x"]) for r in texts.mapInPandas(_measured, "label int, place long, x array<double>").collect())
    x = np.array([r[2] for r in found]).reshape(len(found), len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float)) if len(found) else fit(np.zeros((1, len(FEATURES))), np.full(1, 0.5), rounds=0)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = 20_000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out boolean, score double in (0, 1), predicted int.

    ``labels(doc_id, quality)`` teaches the model, without held-out ids and rows of null id or quality;
    a label given twice counts once, contradicting labels count both. Null and empty texts have the
    score of a text with no words; texts of any length are measured whole. Without labels all scores are one half. Repeated rows get equal results. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = spark.sparkContext.broadcast(train(docs, labels, rows))
    ins = exact(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), ["doc_id"])
    kind = ins.schema["doc_id"].dataType.simpleString()
    return restored(ins.mapInPandas(_scored(model, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int"), docs, ["doc_id"])
