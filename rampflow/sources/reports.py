"""Reports of other tools and of our own: JUnit files, JSON gates, Markdown tables, whole-file replacement."""

from __future__ import annotations

import json
import math
import os
import tempfile
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

JUNIT = "suite string, name string, seconds double, outcome string"


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """Test cases of a JUnit XML file: passed, failed, error or skipped. A file of reporting size."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for case in ElementTree.fromstring(text).iter("testcase"):
        outcome = next((n for tag, n in (("failure", "failed"), ("error", "error"), ("skipped", "skipped")) if case.find(tag) is not None), "passed")
        rows.append((case.get("classname"), case.get("name"), float(case.get("time") or 0), outcome))
    return spark.createDataFrame(rows, JUNIT)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def as_json(df: DataFrame) -> str:
    """Rows as JSON, keys sorted; NaN and infinities as null. For tables of reporting size."""
    fine = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    return json.dumps([{k: fine(v) for k, v in r.asDict().items()} for r in df.collect()], sort_keys=True, indent=2, default=str)


def as_markdown(df: DataFrame, digits: int = 4) -> str:
    """A pipe table; missing values as NA. For tables of reporting size."""
    def cell(v) -> str:
        if v is None or isinstance(v, float) and math.isnan(v):
            return "NA"
        return f"{v:.{digits}g}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def replace_file(path: str, text: str) -> None:
    """Write a driver-side file so that readers see the old or the new one, never a part."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_archive(path: str, members: dict[str, bytes]) -> None:
    """A ZIP that depends on its members alone: by name, with one date, mode and method. For reports, on the driver."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for name in sorted(members):
            entry = zipfile.ZipInfo(name, date_time=(1980, 1, 1, 0, 0, 0))
            entry.compress_type, entry.external_attr, entry.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
            z.writestr(entry, members[name])


def assemble(title: str, sections: list[tuple[str, DataFrame | str]], digits: int = 4) -> str:
    """A Markdown report: a title, and sections of text or of a table of reporting size."""
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else as_markdown(body, digits)]
    return "\n\n".join(parts) + "\n"
