"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import divergence, exact_dedup, filters, langid, mixing, neardup, packing, quality, secrets, sharding, topk, vptree, warc
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op3_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), size=4096)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=80, width=4)


def op9_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), least=0))


def op10_vector_approximation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, query_every=100, scale=1024)


def op11_vantage_point_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_karmarkar_karp_shards,
        op3_systematic_mixing,
        op4_quality_classifier,
        op5_exact_dedup,
        op6_best_fit_packing,
        op7_language_id,
        op8_minhash_near_dedup,
        op9_warc_dictionary,
        op10_vector_approximation_topk,
        op11_vantage_point_ann,
        op12_source_divergence,
        op13_filter_interaction,
    )
}

ORACLE_SQL = {
    "op3_systematic_mixing": mixing.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_minhash_near_dedup": neardup.ORACLE,
    "op9_warc_dictionary": warc.ORACLE,
    "op10_vector_approximation_topk": topk.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
    "op13_filter_interaction": filters.ORACLE,
}
