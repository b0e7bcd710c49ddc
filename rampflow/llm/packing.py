"""Best-fit packing of tokenised documents, bulk-synchronous.

Pieces are range-sorted by length and gaps by size; both are held as runs of equals (a run stands
for any number of rows), so the plan grows with the number of different lengths, at most as many as a sequence
has tokens, and not with the corpus (6,000 to 12,600 runs were measured for up to 1e9 pieces). Sweep by sweep, from the longest pieces down, a run of pieces takes its successor, the
smallest gap that holds it; the k-th piece by rank gets the k-th gap, the gaps shrink, and what is
left of the run goes on to the next successor or opens sequences. Rows find their place by a join
of (length, rank) with the runs; ranks come from a distributed range sort.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact, ranked, restored, small_batches

SEQUENCE = 4096
END_ID = 1
#: Words that a worker remembers (some 200 bytes each); beyond it the memory starts anew.
CACHE_WORDS = 800_000


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The tokenizer never joins what white space parts, so words are encoded once and looked up after.
    A word's closing marks are a piece of their own and are looked up alone; words of plain letters go
    straight to the merge table, all others through the whole tokenizer. Words are lower-cased (A-Z, as
    the tokenizer does itself) only in texts that can't hold a special token's string, since such strings
    are matched before lower-casing.
    """

    #: Closing marks that may be cut off; an apostrophe may begin a contraction and is none.
    MARKS = b".,;:!?%&*$#|)"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        # Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: 256 + i for i, b in enumerate(odd)}

    def _piece(self, w: bytes) -> bytes:
        if (got := self.known.get(w)) is not None:
            return got
        s = w.decode()
        low = s.lower()
        # Letters up to U+017F are composed already, and lower-case one by one.
        if low.isalpha() and s.isalpha() and (s.isascii() or max(s) <= "\u017f"):
            ids = [t.id for t in self.merge(low.encode().decode("latin-1").translate(self.alphabet))]
        else:
            ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        got = self.known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def _word(self, w: bytes) -> bytes:
        stem = w.rstrip(self.MARKS)
        if stem and len(stem) < len(w):
            last = stem[-4:].decode(errors="ignore")[-1:]
            if last.isalpha() or (last.isascii() and last.isdigit()):
                got = self.known[w] = self._piece(stem) + self._piece(w[len(stem) :])
                return got
        return self._piece(w)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, known = [], self.known
        for t in texts:
            b = (t or "").encode()
            words = (b if b"<|" in b else b.lower()).split()
            if missing := set(words).difference(known):
                if len(known) > CACHE_WORDS:
                    known.clear()
                    missing = set(words)
                for w in missing:
                    self._word(w)
            out.append(b"".join(map(known.__getitem__, words)))
        return out


def _pieces(path: str, size: int, end_id: int, ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder(path), end_id.to_bytes(4, "little")
        for pdf in batches:
            texts = pdf["text"].tolist()
            for lo in range(0, len(texts), 256):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, body in zip(pdf["doc_id"].iloc[lo : lo + 256], encoder([t if isinstance(t, str) else None for t in texts[lo : lo + 256]]), strict=True):
                    body += end
                    for p, at in enumerate(range(0, len(body), 4 * size)):
                        part = body[at : at + 4 * size]
                        for k, v in zip(out, (doc, p, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None), strict=True):
                            out[k].append(v)
                yield pd.DataFrame(out)

    return run


def best_fit(counts: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Pack ``counts[length]`` pieces into sequences of ``size``; returns runs and the number of sequences.

    A run (length, lo, hi, sequence, width, offset) places the pieces of that length with rank in
    [lo, hi): rank lo + i goes to sequence + i % width, at offset + length * (i // width).
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of (first sequence, how many)
    sizes: list[int] = []  # sorted keys of gaps
    runs, opened = [], 0

    def add(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in gaps:
                bisect.insort(sizes, free)
            gaps.setdefault(free, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, n = gaps[free].pop()
                if not gaps[free]:
                    del gaps[free], sizes[at]
            else:
                free, first, n = size, opened, -(-left // (size // length))
                opened += n
            # Best fit of equal pieces fills one gap up before the next: what is left of a gap is the smallest fit again.
            each = free // length
            full, rest = divmod(min(left, n * each), each)
            if full:
                runs.append((length, rank, rank + full * each, first, full, size - free))
                add(free - each * length, first, full)
            if rest:
                runs.append((length, rank + full * each, rank + full * each + rest, first + full, 1, size - free))
                add(free - rest * length, first + full, 1)
            used = full + bool(rest)
            add(free, first + used, n - used)
            left, rank = left - full * each - rest, rank + full * each + rest
    return runs, opened


def pack_documents(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every text, end it with ``end_id``, cut texts longer than ``size`` and pack the pieces.

    Returns per piece doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long,
    offset long, and with ``keep_ids`` the ids as little-endian unsigned 32-bit binary. Null and empty
    texts are one piece of length 1, the end id. Repeated rows are packed each for itself. An empty table
    gives no rows; other columns of ``docs`` are ignored, whatever their names. ``tokenizer`` is a
    tokenizers file, by default the public word BPE with 49,408 ids.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    plain = exact(docs, ["doc_id"])
    kind = plain.schema["doc_id"].dataType.simpleString()
    pieces = plain.mapInPandas(_pieces(tokenizer, size, end_id, keep_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = restored(pieces, docs, ["doc_id"])
    pieces = ranked(pieces if keep_ids else pieces.drop("ids"), ["length"], ["doc_id", "piece"], "_rank", "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    runs, _ = best_fit(counts, size)
    plan = spark.createDataFrame(runs, "run_length long, lo long, hi long, first long, width long, at long")
    if len(runs) <= 16 * size:  # 48 bytes a run: at most 3 MB
        plan = F.broadcast(plan)
    out = pieces.join(plan, (F.col("length") == F.col("run_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    i = F.col("_rank") - F.col("lo")
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first") + i % F.col("width")).alias("sequence_id"),
        (F.col("at") + F.col("length") * F.floor(i / F.col("width")).cast("long")).alias("offset"),
        *(["ids"] if keep_ids else []),
    )
