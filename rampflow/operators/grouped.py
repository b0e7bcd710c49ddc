"""The one bridge between Spark and the NumPy kernels: a group's arrays in, rows of a fixed schema out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def per_group(df: DataFrame, keys: list[str], order: list[str], values: list[str], kernel: Callable[..., Iterable[tuple] | tuple | dict], schema: str) -> DataFrame:
    """Run ``kernel(key, *arrays)`` on every group of ``keys``, rows in ``order``; it returns one or several rows.

    Groups are packed into arrays by a native aggregation first, so that many small groups share an Arrow
    batch; a group of one series has to fit a row, as the kernels hold a whole series in any case.
    Nulls arrive as NaN. ``schema`` has the result's own columns; the keys go in front.
    """
    rows = F.sort_array(F.collect_list(F.struct(*dict.fromkeys([*order, *values]))))
    packed = df.groupBy(*keys).agg(rows.alias("_rows"))

    def column(v: str):
        return F.transform("_rows", lambda r: r[v].cast("double"))

    return per_row(packed.select(*keys, *[column(v).alias(f"_v{i}") for i, v in enumerate(values)]), keys, kernel, schema)


def per_row(df: DataFrame, keys: list[str], kernel: Callable[..., Iterable[tuple] | tuple | dict], schema: str) -> DataFrame:
    """The same for rows that hold their arrays already, in the columns after ``keys``."""
    ship(df.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key, arrays = tuple(row[: len(keys)]), [np.array(a, float) for a in row[len(keys) :]]
                made = kernel(key, *arrays)
                for one in made if isinstance(made, list) else [made]:
                    out.append(key + tuple(one[n] for n in names) if isinstance(one, dict) else key + tuple(one))
            yield pd.DataFrame(out, columns=[*keys, *names]).replace({np.nan: None}) if out else pd.DataFrame(columns=[*keys, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    return df.mapInPandas(run, f"{kinds}, {schema}")
