"""Cases that an operator once left out: each failed before the operator did the whole job."""

from __future__ import annotations

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from rampflow.llm import langid, neardup, secrets


def test_secret_neighbours_are_of_the_whole_text(spark):
    """Names with a digit are runs like candidates; they have to stay neighbours of what follows them."""
    h = "4b579d3cee1dcaf48e80dfd04d785e892fc7d365"
    texts = [f'see AUTH0_SECRET = "{h}" there', f"an oauth2_token={h} here", f"its S3_SECRET_KEY: {h} yes", f"of sha256:{h} and", f"with md5 {h} and", "1 2 3 " * 40 + h + " 4 5" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit(""))
    for r in secrets.candidates(docs).where(F.col("value") == h).collect():
        t, at = texts[r["doc_id"]], r["start"]
        assert t[at : at + len(h)] == h
        assert (r["left"], r["right"]) == (t[max(0, at - secrets.NEAR) : at], t[at + len(h) :][: secrets.NEAR])
    got = {r["doc_id"]: (r["secret"], r["kind"]) for r in secrets.scan_secrets(docs).where(F.col("value") == h).collect()}
    assert [got[i] for i in range(3)] == [(True, "token")] * 3
    assert not got[3][0] and not got[4][0]


SHORT_PUNCTUATED_AND_WITHOUT_DIGITS = [
    ('password = "Tr0ub4dor3"', "Tr0ub4dor3"),
    ("set password: P@ssw0rd!2024 today", "P@ssw0rd!2024"),
    ("db_password=CorrectHorseBattery then", "CorrectHorseBattery"),
    ("the token = 'qZrTbWnXkLpVmGhD' is", "qZrTbWnXkLpVmGhD"),
    ('{"client_secret": "hG#9x!kQ2", "user": "jo"}', "hG#9x!kQ2"),
    ("GET /x?passwd=k7Rw2pQz&user=jo", "k7Rw2pQz"),
    ("password=Xk4!vPz9;api_key=Jq8WnB2tLc6Z rest", "Xk4!vPz9"),
    ("password=Xk4!vPz9;api_key=Jq8WnB2tLc6Z rest", "Jq8WnB2tLc6Z"),
]


def test_secrets_of_any_shape_after_a_name(spark):
    texts = [t for t, _ in SHORT_PUNCTUATED_AND_WITHOUT_DIGITS]
    plain = ["password: required for all", "token = None", "secret: ${SECRET}", 'auth_token = os.environ["TOKEN"]', "the author: Miller wrote", "max_tokens = 4096"]
    docs = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string").withColumn("source", F.lit(""))
    got = secrets.scan_secrets(docs).collect()
    assert all((texts + plain)[r["doc_id"]][r["start"] :][: r["length"]] == r["value"] for r in got)
    found = {(r["doc_id"], r["value"]) for r in got if r["secret"]}
    assert {(i, v) for i, (_, v) in enumerate(SHORT_PUNCTUATED_AND_WITHOUT_DIGITS)} <= found
    assert not [f for f in found if f[0] >= len(texts)]


def test_long_values_after_a_name(spark):
    """A value without an end is one candidate, and no search gives up on it."""
    docs = spark.createDataFrame([(1, "token=" + "Ab!x" * 50_000)], "doc_id long, text string").withColumn("source", F.lit(""))
    assert [r["length"] for r in secrets.candidates(docs).select(F.length("value").alias("length")).collect()] == [200_000]


def invented(seed, alphabet):
    """A language: a function that makes texts of n of its 400 words."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(alphabet) for _ in range(r.randint(3, 9))) for _ in range(400)]
    return lambda n: " ".join(r.choice(vocabulary) for _ in range(n))


def test_languages_of_long_documents_fill_their_reference(spark):
    """One short text in a language of long ones must not be all that is learnt of it."""
    a, b = invented(1, "abcdefghijklmno"), invented(2, "abcdefghijklmno")
    rows = [(i, b(60), "b") for i in range(200)] + [(1000 + i, a(900), "a") for i in range(30)] + [(2000, "de ab", "a"), (2002, "de ab", "a"), (2003, "de ab", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.reference_texts(docs, 16_384)
    assert all(16_384 <= len(t) <= 16_384 + 2_048 + 64 for t in held.values()) and set(held) == {"a", "b"}
    got = langid.identify_languages(docs, keep=("lang",)).where("held_out").collect()
    assert {r["lang"] for r in got} == {"a", "b"} and all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 2000)


def test_few_long_documents_and_tiny_languages(spark):
    """One long document gives all that is asked for; a reference of two words takes no documents of others."""
    a, b = invented(3, "abcdefghijklmno"), invented(4, "abcdefghijklmno")
    rows = [(0, a(9000), "a"), (1, "ab", "tiny"), (3, "12 34", "none")] + [(10 + i, b(60), "b") for i in range(200)]
    docs = spark.createDataFrame([x for x in rows], "doc_id long, text string, lang string").where(~langid.held_out(F.col("doc_id")) | (F.col("doc_id") >= 10))
    held = langid.reference_texts(docs, 16_384)
    assert len(held["a"]) >= 16_384 and held["tiny"] == "ab" and "none" not in held
    got = langid.identify_languages(docs, keep=("lang",)).where("lang = 'b'").collect()
    assert {r["lang_pred"] for r in got} == {"b"}


def test_near_duplicates_without_ids(spark):
    """Rows of null id link; one text of a component without an id stays, through the pipeline's stage too."""
    import corpus_pipeline

    r = random.Random(8)
    w = [f"w{i}" for i in range(3000)]
    base, other = [r.choice(w) for _ in range(120)], [r.choice(w) for _ in range(120)]
    edit = lambda words, n: [*words[: len(words) - n], *(f"x{i}" for i in range(n))]
    # 1 and 2 are near the row of null id only; three rows without an id are near each other; one is alone.
    one, two = [*(f"y{i}" for i in range(9)), *base[9:]], edit(base, 9)
    rows = [(1, one), (2, two), (None, base), (None, other), (None, edit(other, 2)), (None, edit(other, 3)), (None, [r.choice(w) for _ in range(50)]), (None, [])]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = neardup.near_duplicates(docs).collect()
    assert {x["doc_id"]: x["component_id"] for x in got if x["doc_id"]} == {1: 1, 2: 1}
    nameless = [x for x in got if x["doc_id"] is None]
    assert sorted(x["component_id"] is None for x in nameless) == [False] + [True] * 5
    assert not any(x["kept"] for x in nameless if x["component_id"] == 1) and sum(x["kept"] for x in nameless) == 3
    kept = corpus_pipeline.near(spark, docs, "").collect()
    assert sorted(x["doc_id"] or 0 for x in kept) == [0, 0, 0, 1]
    others = {" ".join(t) for t in (other, edit(other, 2), edit(other, 3))}
    assert sum(x["text"] in others for x in kept) == 1 and " ".join(base) not in {x["text"] for x in kept}
