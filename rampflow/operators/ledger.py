"""Jobs that are run once: a stored table of finished ones, from which a run that was stopped goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stored(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(at) and any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(at))


def resumed(jobs: DataFrame, keys: list[str], run: Callable[[DataFrame], DataFrame], path: str, waves: int = 8) -> DataFrame:
    """``run`` over the rows of ``jobs``, one result row a job, of which those in the table at ``path`` are not run again.

    ``keys`` tell jobs apart (all that a result depends on has to be among them, as a hash of the input and the settings) and are
    columns of the result. Jobs are run in ``waves``, and each wave is appended to the table when it is done, so that a stopped run
    loses one wave at most. ``path`` is in a store that all executors share. Returns the rows of these jobs; of
    rows that two runs at once may have stored for a job one is taken.
    """
    spark = jobs.sparkSession
    schema = run(jobs).schema

    def done() -> DataFrame:
        return spark.read.schema(schema).parquet(path) if _stored(spark, path) else spark.createDataFrame([], schema)

    wave = F.pmod(F.xxhash64(*keys), F.lit(waves))
    for w in range(waves):
        todo = jobs.where(wave == w).join(done().select(*keys), keys, "left_anti")
        run(todo).write.mode("append").parquet(path)
    return done().join(jobs.select(*keys), keys, "left_semi").dropDuplicates(keys)
