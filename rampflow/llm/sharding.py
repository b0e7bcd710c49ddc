"""Sharding of indivisible groups by Karmarkar-Karp differencing.

A group (the documents of one text) goes to one shard as a whole. Differencing works on partial
partitions: of all of them, the two with the largest spread are combined, the heaviest shard of one
with the lightest of the other, until one is left. Each task combines the groups of its own hash
range; the tasks' partial partitions (24 numbers each) are then combined in the same way, level by level,
PARTS_PER_TASK of them in a task, until one is left. All of it happens on the executors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, ranked, staged

#: Groups that one task combines; bounds its memory (about 80 bytes a shard and group).
GROUPS_PER_TASK = 50_000
#: Partial partitions that one task of a higher level combines.
PARTS_PER_TASK = 2_000


def differencing(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions ``parts[n, k]``; returns shard[n, k], the final shard of each one's slots.

    Equal spreads are taken in the order given, so the result depends on ``parts`` alone.
    """
    n, k = parts.shape
    if not n:
        return np.empty((0, k), np.int64)
    sums = np.zeros((2 * n - 1, k), np.int64)
    order = np.zeros((2 * n - 1, k), np.int16)  # order[i, j]: the slot of node i that is j-th lightest
    sums[:n] = parts
    order[:n] = np.argsort(parts, axis=1, kind="stable")
    ranks = np.take_along_axis(sums[:n], order[:n].astype(np.int64), 1)
    heap = [(int(x), i) for i, x in enumerate(ranks[:, 0] - ranks[:, -1])]
    heapq.heapify(heap)
    kids = np.zeros((n - 1, 2), np.int64)
    for new in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        kids[new - n] = a, b
        s = sums[a][order[a]] + sums[b][order[b][::-1]]
        sums[new], order[new] = s, np.argsort(s, kind="stable")
        heapq.heappush(heap, (int(s.min() - s.max()), new))
    shard = np.zeros((2 * n - 1, k), np.int16)
    shard[-1] = np.arange(k)
    for new in range(2 * n - 2, n - 1, -1):
        a, b = kids[new - n]
        shard[a][order[a]] = shard[new]
        shard[b][order[b][::-1]] = shard[new]
    return shard[:n].astype(np.int64)


def _combine(shards: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([*batches, pd.DataFrame({"digest": pd.Series(dtype=object), "bytes": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})], ignore_index=True)
        if not len(pdf):
            return
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True], ignore_index=True)
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, -1] = pdf["bytes"]
        slot = differencing(parts)[:, -1]
        yield pd.DataFrame({"digest": pdf["digest"], "n": pdf["n"], "part": TaskContext.get().partitionId(), "slot": slot, "bytes": pdf["bytes"]})

    return run


def _combine_parts(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, at = np.unique(pdf["part"], return_inverse=True)
        sums = np.zeros((len(parts), shards), np.int64)
        sums[at, pdf["slot"]] = pdf["bytes"]
        return pdf.assign(up_slot=differencing(sums)[at, pdf["slot"]])[["part", "slot", "up", "up_slot", "bytes"]]

    return run


def _moves(local: DataFrame, shards: int) -> DataFrame:
    """(part, slot, shard): where each slot of the tasks' partial partitions ends."""
    spark, levels = local.sparkSession, []
    parts = local.groupBy("part", "slot").agg(F.sum("bytes").alias("bytes"))
    # A slot that no group of its part is in has no bytes; it is a slot all the same.
    all_slots = spark.range(shards).select(F.col("id").cast("int").alias("slot"))
    parts = parts.select("part").distinct().crossJoin(F.broadcast(all_slots)).join(parts, ["part", "slot"], "left").fillna(0, "bytes")
    parts = staged(parts, "shard-parts")
    while True:
        level = parts.withColumn("up", F.floor(F.col("part") / PARTS_PER_TASK).cast("int")).groupBy("up")
        level = staged(level.applyInPandas(_combine_parts(shards), "part int, slot int, up int, up_slot int, bytes long"), "shard-level")
        levels.append(level)
        parts = level.groupBy(F.col("up").alias("part"), F.col("up_slot").alias("slot")).agg(F.sum("bytes").alias("bytes"))
        if level.where("up > 0").isEmpty():
            break
    moves = levels.pop().select("part", "slot", F.col("up_slot").alias("shard"))
    while levels:
        above = moves.select(F.col("part").alias("up"), F.col("slot").alias("up_slot"), "shard")
        moves = levels.pop().join(above, ["up", "up_slot"]).select("part", "slot", "shard")
    return staged(moves, "shard-moves")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` in shards 0..shards-1 of nearly equal bytes, equal texts together.

    Returns doc_id, size long (UTF-8 bytes, null none, plus 8), text_crc32 long (null: that of no
    bytes, 0), law 'bytes', shard int, slot long (gapless from 0 in each shard, by doc_id),
    grown_shard int (null). Null texts are one group with empty ones. Repeated rows are equal
    texts and stay together, each with a slot. A group heavier than an even share fills a shard by itself.
    Texts of any length count whole; rows of equal doc_id take neighbouring slots in no certain order.
    An empty table gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"),
    )
    rows = staged(rows, "shard-rows")
    groups = staged(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    tasks = max(1, -(-groups.count() // GROUPS_PER_TASK))
    local = groups.repartition(tasks, "digest").mapInPandas(_combine(shards), "digest string, n long, part int, slot int, bytes long")
    local = staged(local, "shard-local")
    placed = staged(local.join(_moves(local, shards), ["part", "slot"]).select("digest", "n", "shard"), "shard-placed")
    out = looked_up(rows, placed, "digest", "n", "doc_id").select("doc_id", "size", "text_crc32", "shard")
    out = ranked(out, ["shard"], ["doc_id"], "slot", "shard-slots")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
