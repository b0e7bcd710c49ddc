"""A corpus pipeline of the training-data operators: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Every stage is written as Parquet to the shared folder and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rampflow.llm import exact_dedup, langid, mixing, neardup, packing
from rampflow.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can be told stay; null texts and texts without a letter (``und``) go. Other columns stay as they are."""
    found = langid.identify_languages(docs, keep=("text", "lang", "source", "n_chars"))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id stays; of repeated rows one."""
    return exact_dedup.drop_exact_duplicates(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of the smallest id stays, or one of those without an id.

    Null texts and texts without a word are in no group and stay; of repeated rows all stay or go.
    """
    found = neardup.near_duplicates(docs, percent=80, width=5, row="at")
    kept = found.where("kept").select(F.col("doc_id").alias("id"), "at").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & neardup.row_of(F.col("doc_id"), F.col("text")).eqNullSafe(F.col("at"))
    return docs.join(kept, same, "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times; null texts go, empty texts are drawn like the small texts of their source.

    Rows find their copies by id and text, so that rows without an id do not meet; of rows equal in both, the n-th
    draws for the n-th.
    """
    docs = docs.select(*COLUMNS).where("text is not null").withColumns({"at": F.xxhash64("text"), "of": F.col("source")})
    nth = F.row_number().over(Window.partitionBy("doc_id", "at").orderBy("of"))
    drawn = mixing.mix_sources(docs, keep=("at", "of")).withColumn("nth", nth).where("copies > 0")
    drawn = drawn.select(F.col("doc_id").alias("_id"), F.col("at").alias("_at"), F.col("nth").alias("_nth"), "copies")
    taken = docs.withColumn("nth", nth).join(drawn, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("at") == F.col("_at")) & (F.col("nth") == F.col("_nth")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens; a null or empty text is its end id alone, and copies are packed each for itself."""
    return packing.pack_documents(docs, size=4096)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Suffix automata, sketches and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
