"""Every operator on awkward tables: nulls in any column, empty and long texts, ties, repeats, no rows, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rampflow.llm import exact_dedup, langid, mixing, neardup, packing, quality, secrets, sharding, topk, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, norm string, place int, _pid int, keep_id string"
BIG = 2**60 + 1


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    out = [(i, text(40 + i), ("en", "de")[i % 2], ("a", "b", None)[i % 3], 1) for i in range(12)]
    out += [(20, None, None, None, None), (21, "", "en", "a", 0), (22, " \t\n ", "en", "a", 3), (23, "12 34", "en", "", 5)]
    out += [(None, "no id at all here", "en", "a", 1), (None, None, None, None, None), (BIG, out[0][1], "en", "a", 1), (BIG + 2, text(30_000), "de", "b", 1)]
    out += [out[3], out[3]]
    return [(*x, 9, "d", "n", 1, 2, "k") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda d, l: secrets.scan_secrets(d),
    "sharding": lambda d, l: sharding.shard_documents(d),
    "mixing": lambda d, l: mixing.mix_sources(d),
    "quality": lambda d, l: quality.score_quality(d, l),
    "exact": lambda d, l: exact_dedup.exact_duplicates(d),
    "drop_exact": lambda d, l: exact_dedup.drop_exact_duplicates(d),
    "packing": lambda d, l: packing.pack_documents(d),
    "langid": lambda d, l: langid.identify_languages(d),
    "neardup": lambda d, l: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_no_rows(docs, none, labels, name):
    f = OPERATORS[name]
    assert f(none, labels.limit(0)).collect() == []
    got = f(docs, labels).collect()
    if name in ("sharding", "mixing", "quality", "exact", "langid", "neardup"):
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((x[0] is None, x[0] or 0) for x in rows())
    if name == "packing":
        assert {r["doc_id"] for r in got} == {x[0] for x in rows()}


def test_quality_without_labels(docs, labels):
    assert len({r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()}) == 1


def test_languages_without_labels(docs):
    assert {r["lang_pred"] for r in langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_undetermined_texts(docs):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(docs).where("doc_id in (20, 21, 22, 23)").collect()}
    assert set(got.values()) == {"und"}


def test_exact_ties(docs):
    got = exact_dedup.exact_duplicates(docs).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[BIG]["keep_id"] == 0 and not by[BIG]["kept"] and by[0]["kept"]
    assert by[20]["keep_id"] == by[21]["keep_id"] == 20 and by[20]["group_size"] == 3  # with the null text of null id
    assert by[22]["group_size"] == 1  # one space, not nothing
    assert sum(r["kept"] for r in got if r["doc_id"] == 3) == 3
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 1 and BIG not in ids and 21 not in ids


def test_near_duplicates_of_equal_and_empty_texts(docs):
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert got[BIG]["component_id"] == 0 and not got[BIG]["kept"]
    assert all(got[i]["n_shingles"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (20, 21, 22))
    assert got[23]["n_shingles"] == 1


def test_mixing_of_null_sources(docs):
    got = mixing.mix_sources(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["target"] for r in {(r["source_size"], r["target"]): r for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))


def test_pages(spark):
    schema = "page_id long, url string, html string, sha1 string, payload string"
    rows = [(1, "http://a/\r\nx", "<p>é</p>", "x", "y"), (2, None, "<p>é</p>", "x", "y"), (3, "u", None, "x", "y"), (4, "u", "", "x", "y"), (None, "u", "", "x", "y"), (5, "u", "z" * 300_000, "x", "y"), (BIG, "u", "z" * 300_000, "x", "y")]
    pages = spark.createDataFrame(rows, schema)
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert len(got) == len(rows)
    assert got[1]["record_type"] == "response" and got[1]["payload_bytes"] == 9
    assert got[2]["refers_to"] == 1 and got[2]["payload_bytes"] == 9
    assert got[4]["refers_to"] == 3 and got[None]["refers_to"] == 3 and got[BIG]["refers_to"] == 5
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []
    assert all(r["record_type"] == "response" for r in warc.read_archives(warc.write_archives(pages, least=10**6)).collect())


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [2.0]), (100, [1.0, 0.0]), (2, [0.5, 0.5])]
    v = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<double>, score int, row string")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(v, k=3).collect()]
    one = 1024 * 1024
    assert sorted(got) == [(0, 1, 7, 2 * one), (0, 2, 100, one), (0, 3, 1, one // 2), (100, 1, 7, 2 * one), (100, 2, 0, one), (100, 3, 1, one // 2)]
    assert topk.search(v.limit(0)).collect() == []
    assert topk.search(v.where("vec_id = 1")).collect() == []


def test_stages(spark, docs, none):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none.select(*corpus_pipeline.COLUMNS), "").collect() == [], name
        got = stage(spark, docs, "")
        if name != "pack":
            assert got.columns == corpus_pipeline.COLUMNS
        assert got.count() > 0
    once = corpus_pipeline.exact(spark, docs, "")
    assert once.groupBy("doc_id").count().where("count > 1 and doc_id is not null").count() == 0
    assert docs.where("text is null").count() == 2 and corpus_pipeline.mix(spark, docs, "").where("text is null").count() == 0
    mixed = corpus_pipeline.mix(spark, docs, "").groupBy("doc_id").count().collect()
    drawn = {r["doc_id"]: r["n"] for r in mixing.mix_sources(docs.where("text is not null")).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    assert {r["doc_id"]: r["count"] for r in mixed} == drawn


SECRET = 'token = "4b579d3cee1dcaf48e80dfd04d785e892fc7d365"'


def test_secrets_in_awkward_rows(spark):
    """Null path, repeated rows, a secret at the end of a very long text, null and empty texts."""
    long = "word " * 200_000
    docs = [(1, SECRET, None), (1, SECRET, None), (2, long + SECRET, "a"), (3, None, None), (4, "", "a"), (None, SECRET, "a")]
    got = secrets.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("secret").collect()
    assert sorted((r["doc_id"] or 0, r["start"]) for r in got) == [(0, 9), (1, 9), (1, 9), (2, len(long) + 9)]
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_packing_of_null_empty_and_repeated_texts(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a few words"), (4, "a few words"), (None, "no id")]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs) and {r["piece"] for r in got} == {0} and {r["start"] for r in got} == {0}
    assert {r["length"] for r in got if r["doc_id"] in (1, 2, 3)} == {1} and len({r["ids_crc32"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["offset"] for r in got}) == len(docs) and len({r["sequence_id"] for r in got}) == 1


def test_shards_of_null_empty_and_repeated_texts(spark):
    docs = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (5, "y")]
    got = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards=3).collect()
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {8} and {r["text_crc32"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert len({r["shard"] for r in got if r["size"] == 9 and r["doc_id"] != 5}) == 1
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_mixing_ties(spark):
    """Rows equal in size and id: as many copies as sources ask for, none above three, and the same again."""
    docs = spark.createDataFrame([(7, f"a b {i}", "s") for i in range(30)] + [(8, "x y z", "t")] * 30, "doc_id long, text string, source string")
    first, again = ([sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(d).collect()) for d in (docs, docs.repartition(5))])
    assert first == again and max(t for _, t in first) <= 9
    assert abs(sum(t for i, t in first if i == 7) - 60) <= 3 and abs(sum(t for i, t in first if i == 8) - 120) <= 3


def test_mix_drops_null_texts_and_draws_empty_ones(spark):
    """Twenty null texts, with and without ids, beside empty ones: none of the null ones stays, in any source."""
    rows = [(i if i % 2 else None, None, "en", "s", None) for i in range(20)] + [(100 + i, "", "en", "s", 0) for i in range(12)] + [(200 + i, "a b c d", "en", ("s", "t")[i % 2], 7) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.mix(spark, docs, "").collect()
    drawn = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs.where("text is not null")).collect()}
    assert all(r["text"] is not None for r in kept)
    assert sum(r["text"] == "" for r in kept) == sum(n for i, n in drawn.items() if 100 <= i < 200) and len(kept) == sum(drawn.values())


def test_quality_of_equal_and_empty_texts(docs, labels):
    got = quality.score_quality(docs, labels).collect()
    by = {i: {r["score"] for r in got if r["doc_id"] == i} for i in (3, 20, 21, 22)}
    assert len(by[3]) == 1 and by[20] == by[21] and all(0 < s < 1 for v in by.values() for s in v)


def test_language_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(i, f"{w} " * 30, lang, "s") for i, (w, lang) in enumerate([("the quick brown fox", "en"), ("der schnelle braune fuchs", "de")] * 8)] + [(100, "der braune fuchs " * 60_000, None, "s")], "doc_id long, text string, lang string, source string")
    assert [r["lang_pred"] for r in langid.identify_languages(docs).where("doc_id = 100").collect()] == ["de"]


def test_object_stores_by_spark_names():
    for uri, want in (("s3a://b/k", "s3://b/k"), ("s3n://b/k", "s3://b/k"), ("s3://b/s3a://k", "s3://b/s3a://k"), ("file:///s3a", "file:///s3a"), ("hdfs://n/x", "hdfs://n/x")):
        assert warc.arrow_uri(uri) == want


def test_languages_of_a_huge_text_in_windows(monkeypatch):
    """States are carried over windows: the same phrases as in one piece, and memory that does not grow with the text."""
    import tracemalloc

    r = random.Random(3)
    samples = {f"l{i:02}": " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)) for i in range(20)}
    model = langid.train(samples)
    texts = [" ".join(samples[f"l{i:02}"].split()[k % 300] for k in range(i, i + 900)) for i in range(3)] + ["ab cd", "x" * 700]
    codes = [langid.encode(model.code, t) for t in texts]
    whole = langid.phrases(model, codes)
    monkeypatch.setattr(langid, "STEP", 20 * 512)
    assert (langid.counted(model, codes) == whole).all()
    monkeypatch.undo()
    text = texts[1] * 2000
    assert len(text) > 9_000_000
    tracemalloc.start()
    assert langid.classify(model, [text])[0][0] == "l01"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def test_archives_of_repeated_and_null_ids(spark):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, None, "same"), (None, "u", "same"), (None, "u", "alone"), (3, "u", None), (4, "u", "")], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(pages)).collect())
    assert got == [(0, "response", 0, 5), (0, "revisit", 1, 4), (1, "response", 0, 4), (1, "response", 0, 4), (2, "revisit", 1, 4), (3, "response", 0, 0), (4, "revisit", 3, 0)]
