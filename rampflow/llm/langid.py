"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text recognises all its substrings. A text is parsed
greedily into the longest phrases that occur there; ``phrases * log2(reference length) / length``
estimates the cross entropy, and the language with the least wins. The reference length is that of the
longest reference, for all: a phrase costs the same everywhere, so that a short reference, which has
the shorter phrases, cannot win by its length.

The automata are double arrays, about 35 bytes a letter of reference whatever the alphabet. Stretches of
texts walk them in lock step, so a parse is a few array look-ups a letter; a stretch is then walked
again from the state in which the one before it ends, until both walks are in one state, so that
phrases run on across stretches and the count is that of the whole text's parse.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact, restored, small_batches, staged

#: Codes: 0 any run of non-letters, 1 letters that no reference has (no transition reads them), 2 padding, 3.. letters.
OTHER, PAD, FIRST = 1, 2, 3
#: Codes of a text that are walked in lock step with others.
STRETCH = 256
#: Codes of text, padding included, times languages that one step holds at most.
STEP = 2_000_000
#: Letters of all references together: at most some 150 MB are broadcast.
MOST_LETTERS = 4_000_000
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # code point -> code
    base: np.ndarray  # state -> where its slots start
    owner: np.ndarray  # slot -> the state whose transition it holds, or -1
    target: np.ndarray  # slot -> next state
    first: np.ndarray  # [language, code] state after one letter, the root if there is none
    roots: np.ndarray  # per language
    scale: float  # log2 of the longest reference's length

    @cached_property
    def indexes(self) -> tuple[np.ndarray, ...]:
        """base, owner, target and first in the type that look-ups take without conversion."""
        return tuple(x.ravel().astype(np.intp) for x in (self.base, self.owner, self.target, self.first))


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


def double_array(nxt: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): the transition of state s by code c is at slot base[s] + c if s owns that slot.

    States take the first place in which all their slots are free, those of most transitions first; a state of one
    transition takes the first free slot. Codes are below ``width``.
    """
    base, slots = np.zeros(len(nxt), np.int64), {}
    size = 2 * width + sum(map(len, nxt))
    used = bytearray(size)
    free = low = width
    for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
        if not nxt[s]:
            break
        codes = sorted(nxt[s])
        while used[free]:
            free += 1
        # Places that many states have tried in vain are left to states of one transition.
        at, tries = free if len(codes) == 1 else max(free, used.find(0, low)), 0
        while True:
            b = at - codes[0]
            if b + codes[-1] >= len(used):
                used.extend(bytes(len(used)))
            if not any(used[b + c] for c in codes):
                break
            tries += 1
            if tries == 64:
                low = at
            at = used.find(0, at + 1)
            if at < 0:
                at = len(used)
                used.extend(bytes(len(used)))
        base[s] = b
        for c in codes:
            used[b + c] = 1
            slots[b + c] = (s, nxt[s][c])
    owner, target = np.full(max(slots, default=0) + width + 1, -1, np.int64), np.zeros(max(slots, default=0) + width + 1, np.int64)
    for slot, (s, t) in slots.items():
        owner[slot], target[slot] = s, t
    return base, owner, target


def encode(code: np.ndarray, text: str) -> np.ndarray:
    """Codes of a text, one for each letter and one for each run of other characters."""
    x = code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(x):
        x = x[(x != 0) | np.concatenate(([True], x[:-1] != 0))]
    return x


def _codes(alphabet: list[str]) -> np.ndarray:
    at = {c: i + FIRST for i, c in enumerate(alphabet)}
    code = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            code[cp] = at.get(c.lower()[0], OTHER)
    return code


def train(samples: dict[str, str]) -> Model:
    """samples: reference text per language. The alphabet has all letters of all of them, most frequent first."""
    seen = Counter(x[0] for t in samples.values() for c in set(t) if c.isalpha() for x in [c.lower()])
    for t in samples.values():
        seen.update(c for c in t.lower() if c in seen)
    code = _codes([c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))])
    width, longest = len(seen) + FIRST, 2
    languages = sorted(samples)
    first, roots, parts, states, slots = np.zeros((len(languages), width), np.int64), [], [], 0, 0
    for i, lang in enumerate(languages):
        codes = encode(code, samples[lang])
        nxt = suffix_automaton(codes.tolist())
        base, owner, target = double_array(nxt, width)
        first[i] = states
        for c, t in nxt[0].items():
            first[i, c] = states + t
        parts.append((base + slots, np.where(owner < 0, -1, owner + states), target + states))
        roots.append(states)
        longest, states, slots = max(longest, len(codes)), states + len(nxt), slots + len(owner)
    kind = np.int32 if max(states, slots) < 2**31 else np.int64
    base, owner, target = (np.concatenate([p[k] for p in parts]).astype(kind) if parts else np.empty(0, kind) for k in range(3))
    return Model(languages, code, base, owner, target, first.astype(kind), np.array(roots, kind), float(np.log2(longest)))


def walked(model: Model, codes: list[np.ndarray], carried: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases [text, language] of the greedy cross-parse of each text, and each language's state after the last stretch.

    ``carried`` are states in which the first text begins, those that the codes before it end in.
    """
    n, rows = len(model.languages), [-(-len(x) // STRETCH) for x in codes]
    width, stretches = model.first.shape[1], sum(rows)
    flat = np.full(stretches * STRETCH, PAD, np.intp)
    at, follows = 0, np.ones(stretches, bool)
    for x, r in zip(codes, rows, strict=True):
        flat[at : at + len(x)] = x
        if r:
            follows[at // STRETCH] = False
        at += r * STRETCH
    columns = np.ascontiguousarray(flat.reshape(-1, STRETCH).T)
    base, owner, target, first = model.indexes
    # Element l * stretches + j is the walk of stretch j in language l.
    root = np.repeat(model.roots.astype(np.intp), stretches)
    row = np.repeat(np.arange(n, dtype=np.intp) * width, stretches)
    held = np.empty((STRETCH, n * stretches), np.intp)
    starts = np.empty(held.shape, bool)

    def walk(state: np.ndarray, c: np.ndarray, root: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # A phrase starts at a root, where nothing is matched yet, and where the match cannot go on.
        slot = base.take(state) + c
        stop = owner.take(slot) != state
        after = target.take(slot)
        again = np.flatnonzero(stop)
        after[again] = first.take(row.take(again) + c.take(again))
        return after, ((state == root) | stop) & (c != PAD)

    state = root.copy()
    if carried is not None:
        state[::stretches] = carried
    for t, c in enumerate(columns):
        held[t], starts[t] = state, now = walk(state, np.tile(c, n), root, row)
    count = starts.sum(0, dtype=np.int64)
    todo = np.flatnonzero(np.tile(follows, n))
    todo = todo[held[-1, todo - 1] != root[todo]]
    while len(todo):
        # From the state that the stretch before ends in; once the two walks of a stretch meet they stay together.
        state = held[-1, todo - 1]
        for t in range(STRETCH):
            state, now = walk(state, columns[t].take(todo % stretches), root[todo], row[todo])
            count[todo] += now.astype(np.int64) - starts[t, todo]
            apart = state != held[t, todo]
            held[t, todo], starts[t, todo] = state, now
            todo, state = todo[apart], state[apart]
            if not len(todo):
                break
        todo = todo[(todo + 1) % stretches != 0] + 1
        todo = todo[follows[todo % stretches]]
    count = count.reshape(n, stretches)
    ends = np.cumsum(rows)
    total = np.concatenate((np.zeros((n, 1), np.int64), np.cumsum(count, 1)), 1)
    return (total[:, ends] - total[:, ends - rows]).T, held[-1].reshape(n, stretches)[:, -1].copy()


def phrases(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """Phrases [text, language] of the greedy cross-parse of each text, all in one piece."""
    return walked(model, codes)[0]


def counted(model: Model, codes: list[np.ndarray]) -> np.ndarray:
    """``phrases`` of texts of any length: long ones are walked in windows that carry their states on, so memory has a bound."""
    n = len(model.languages)
    window = max(1, STEP // (n * STRETCH)) * STRETCH
    out = np.zeros((len(codes), n), np.int64)
    short = [i for i, x in enumerate(codes) if len(x) <= window]
    lo, held = 0, 0
    for k, i in enumerate(short):
        held += -(-len(codes[i]) // STRETCH) * STRETCH
        if held >= window or k == len(short) - 1:
            out[short[lo : k + 1]] = phrases(model, [codes[j] for j in short[lo : k + 1]])
            lo, held = k + 1, 0
    for i in (i for i, x in enumerate(codes) if len(x) > window):
        carried = None
        for at in range(0, len(codes[i]), window):
            found, carried = walked(model, [codes[i][at : at + window]], carried)
            out[i] += found[0]
    return out


def classify(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text. score: 1 - best / second-best entropy; 1 with one language alone."""
    codes = [encode(model.code, t) if t else np.empty(0, np.int32) for t in texts]
    out = [(UNDETERMINED, 0.0)] * len(texts)
    some = [i for i, x in enumerate(codes) if len(x) and x.any()]
    if not some or not model.languages:
        return out
    entropy = counted(model, [codes[i] for i in some]) * model.scale / np.array([len(codes[i]) for i in some])[:, None]
    best = entropy.argmin(1)
    two = np.partition(entropy, 1, axis=1)[:, :2] if entropy.shape[1] > 1 else None
    for k, i in enumerate(some):
        out[i] = (model.languages[best[k]], 1.0 if two is None else float(max(0.0, 1 - two[k, 0] / two[k, 1])))
    return out


def _scored(model, column: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf[column]]
            found, lo, held = [], 0, 0
            for i, t in enumerate(texts):  # codes of a few texts at a time
                held += len(t or "")
                if held >= STEP:
                    found += classify(model.value, texts[lo : i + 1])
                    lo, held = i + 1, 0
            found += classify(model.value, texts[lo:])
            yield pdf.drop(columns="_text", errors="ignore").assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    return run


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _levels(held: dict[int, int], need: int) -> int:
    """The least level to read so that levels from there on hold ``need`` letters; 0 if all do not."""
    for level in sorted(held, reverse=True):
        need -= held[level]
        if need <= 0:
            return level
    return 0


def reference_texts(docs: DataFrame, letters: int, languages: int = 4_096) -> dict[str, str]:
    """Per language, text of labelled documents until it holds ``letters`` codes, or all there is.

    At most ``languages`` languages are learnt, those of most text, and where there are more than
    MOST_LETTERS / letters of them, each has its equal part of MOST_LETTERS; so the model has a bound.

    Counted and kept are letters and runs of other characters, as ``encode`` has them. Texts of at most
    ``letters / 8`` come first, whole and in the order of their hashes, so that no single document makes a
    language; then stretches of that length of the longer ones, first their beginnings. Equal texts count once.
    Only hashes below a bound are read: level n of a hash, its leading zeros, has one of 2 ** (n + 1) texts,
    and the levels' letters are summed beforehand.
    """
    stretch = max(1, letters // 8)
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = rows.select("lang", F.regexp_replace("text", r"\P{L}+", " ").alias("text"))
    place = F.shiftrightunsigned(F.xxhash64("text"), 1)
    rows = rows.select("lang", "text", place.alias("place"), (F.length("text") > stretch).alias("long"), (63 - F.length(F.bin(place))).alias("level"))
    sizes = rows.select("lang", "place", "long", "level", F.least(F.length("text"), F.lit(stretch)).alias("n")).distinct().groupBy("lang", "long", "level").agg(F.sum("n").alias("n"))
    sizes = staged(sizes, "language-sizes")
    most = sizes.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(languages).select("lang")
    sizes = sizes.join(F.broadcast(most), "lang")
    held: dict[str, tuple[dict[int, int], dict[int, int]]] = {}
    for r in sizes.collect():
        held.setdefault(r["lang"], ({}, {}))[r["long"]][r["level"]] = r["n"]
    letters, found = min(letters, max(1, MOST_LETTERS // max(1, len(held)))), []
    for lang, (short, long) in held.items():
        need = letters - sum(short.values())
        # Where even all beginnings are too few, there are less than eight longer texts, and more of them is read.
        found.append((lang, _levels(short, letters), _levels(long, need) if need > 0 else 64, stretch if sum(long.values()) >= need else letters))
    if not found:
        return {}
    per = docs.sparkSession.createDataFrame(found, "lang string, from_short int, from_long int, most int")
    chosen = rows.join(F.broadcast(per), "lang").where(F.col("level") >= F.when(F.col("long"), F.col("from_long")).otherwise(F.col("from_short")))
    chosen = chosen.select("lang", "long", "place", F.substring("text", F.lit(1), F.col("most")).alias("text")).dropDuplicates()
    pieces = [(r["lang"], r["long"], i, r["place"], r["text"][i : i + stretch]) for r in chosen.collect() for i in range(0, len(r["text"]), stretch)]
    out: dict[str, list[str]] = {}
    for lang, *_, text in sorted(pieces):
        have = out.setdefault(lang, [])
        if sum(map(len, have)) < letters:
            have.append(text)
    return {k: "\n".join(v) for k, v in out.items()}


def identify_languages(docs: DataFrame, letters: int = 16_384, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out boolean, lang_pred string, score double, and the columns ``keep``.

    Learns from text and non-null lang of rows that are not held out; ids and labels are no inputs of a
    prediction. Null texts and texts without a letter are ``und`` with score 0; so is everything if no
    row is labelled. Ties go to the first language by name. Repeated rows get equal results; texts of any length are
    parsed whole. An empty
    table gives no rows; columns of ``docs`` not named are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = spark.sparkContext.broadcast(train(reference_texts(rows, letters)))
    text = "_text" if text_col not in keep else text_col
    like = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), *keep, *([F.col(text_col).alias(text)] if text_col not in keep else []))
    ins = exact(like, ["doc_id", *keep])
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ins.schema.fields if f.name != "_text")
    out = ins.mapInPandas(_scored(model, text), f"{types}, lang_pred string, score double")
    return restored(out, like, ["doc_id", *keep]).select("doc_id", "held_out", "lang_pred", "score", *keep)
