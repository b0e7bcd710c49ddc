"""Text sinks with explicit missing values, manifests, and path guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(path: str, root: str) -> str:
    """``path`` if it lies under ``root`` once dots are resolved; an error if not."""
    parts: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"{path} leaves its root")
            parts.pop()
        elif p != ".":
            parts.append(p)
    clean = "/".join(parts)
    if clean != root.rstrip("/") and not clean.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is not under {root}")
    return clean


def as_text(c: Column, kind: str) -> Column:
    """NA for null and NaN; numbers as they print."""
    if kind in ("double", "float"):
        return F.when(c.isNull() | F.isnan(c), "NA").otherwise(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit("NA"))


def exact_text(c: Column) -> Column:
    """17 significant digits, enough to read the same double back; NA for null and NaN."""
    return F.when(c.isNull() | F.isnan(c), "NA").otherwise(F.format_string("%.17g", c))


def write_table(df: DataFrame, path: str, root: str, sep: str = ",", strict: bool = False, exact: bool = False) -> None:
    """One UTF-8 file with header, LF and NA for missing values; ``strict`` refuses blank cells.

    For results of reporting size: the one output file is written by one task.
    """
    path = within(path, root)
    out = df.select(*[exact_text(F.col(n)).alias(n) if exact and k == "double" else as_text(F.col(n), k).alias(n) for n, k in df.dtypes])
    if strict and out.where(" or ".join(f"trim(`{c}`) = ''" for c in out.columns)).limit(1).count():
        raise ValueError("blank cells")
    out.coalesce(1).write.mode("overwrite").options(header=True, sep=sep, lineSep="\n", emptyValue="", nullValue="NA").csv(path)


def checksum_lines(files: DataFrame, root: str) -> DataFrame:
    """Lines of a checksum file, ``sha256  relative path``, by path; ``files`` as of sources.beats.file_hashes."""
    relative = F.regexp_replace("path", F.lit("^.*?" + root.rstrip("/").replace(".", "\\.") + "/"), F.lit(""))
    return files.select(F.concat_ws("  ", "sha256", relative).alias("value"), relative.alias("_p")).orderBy("_p").select("value")


def manifest(files: DataFrame) -> DataFrame:
    """sha256, size and path of files, by path; ``files`` as of sources.beats.file_hashes."""
    return files.select("sha256", "size_bytes", "path").orderBy("path")
