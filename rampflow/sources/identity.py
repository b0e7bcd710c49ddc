"""Input identity: files that are expected against files that are there, by name and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a recorded hash was taken.
RAW, EOL = "raw_bytes", "eol_normalized_lf_bytes"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def expected_hashes(inventory: DataFrame, pattern: str) -> DataFrame:
    """(file_name, expected) of an inventory (path, sha256) whose names match the whole ``pattern``."""
    name = file_name(F.col("path"))
    return inventory.where(name.rlike(f"^(?:{pattern})$")).select(name.alias("file_name"), F.lower("sha256").alias("expected"))


def identity(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per expected or found file: expected and observed hash (NA if there is none) and whether they match.

    ``expected(file_name, expected)``; ``found`` as of sources.beats.file_hashes. A file that nobody expects is no match either.
    """
    seen = found.select(file_name(F.col("path")).alias("file_name"), F.lower("sha256").alias("observed"))
    both = expected.join(seen, "file_name", "full_outer")
    match = F.coalesce(F.col("expected") == F.col("observed"), F.lit(False))
    return both.select("file_name", F.coalesce("expected", F.lit("NA")).alias("expected"), F.coalesce("observed", F.lit("NA")).alias("observed"), match.alias("hash_match"))


def hash_entries(anchors: DataFrame, column: str = "entries") -> DataFrame:
    """(name, sha256, mode) of a JSON object that maps names to a hash or to {sha256, mode}; others are errors.

    A bare hash is one of raw bytes. Hashes are in upper case.
    """
    pairs = anchors.select(F.explode(F.from_json(column, T.MapType(T.StringType(), T.StringType()))).alias("name", "entry"))
    parsed = F.from_json("entry", "sha256 string, mode string")
    nested = F.col("entry").startswith("{")
    fine = ~nested | (parsed["sha256"].isNotNull() & F.coalesce(parsed["mode"].isin(RAW, EOL), F.lit(False)))
    sha = F.when(nested, parsed["sha256"]).otherwise(F.col("entry"))
    checked = F.when(fine, F.upper(sha)).otherwise(F.raise_error(F.concat(F.lit("not a hash entry: "), F.col("name"))).cast("string"))
    return pairs.select("name", checked.alias("sha256"), F.when(nested, parsed["mode"]).otherwise(F.lit(RAW)).alias("mode"))
