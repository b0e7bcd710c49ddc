"""Shared pieces of the training-data operators: scratch tables, skew-proof ranks, safe columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = " \\t-\\r"
WORD = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster must name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="rampflow-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(_remove, spark, at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone at exit; nothing is lost but the clean-up
        return


_KEPT: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; the application's paths go when its driver ends."""
    home = f"{shared_dir(spark)}/rampflow/{spark.sparkContext.applicationId}"
    if home not in _KEPT:
        _KEPT.add(home)
        atexit.register(_remove, spark, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends, a lost executor costs no rerun."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of ``most`` bytes at most, so that two of a Python worker's batches of texts fit beside its work.

    The setting is one of the session and stays, since results are computed when they are asked for; a smaller one is left.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).rstrip("bB")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, most)


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, name: str, totals: dict[str, str] | None = None) -> DataFrame:
    """Add ``out``: the row's place from 0 among rows of equal ``keys`` under ``order``.

    Rows are range-partitioned on keys and order, so that a key with a third of all rows is
    spread over many tasks; what crosses tasks is one count per (task, key). ``totals`` maps a
    new column to a long column to be prefix-summed likewise (sum over the rows before this one).
    Nulls are keys like others and sort first. Rows equal in keys and order get different places.
    """
    spark, totals = df.sparkSession, totals or {}
    held = (
        staged(df, f"{name}-in")  # range partitioning reads its input twice, to sample and to deal
        .repartitionByRange(partitions(spark), *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    held = staged(held, name)
    parts = held.groupBy(*keys, "_pid").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_pid").alias("_kpid"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in totals],
    )
    on: Column = F.col("_pid") == F.col("_kpid")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = held.join(parts, on).withColumn(out, F.col("_pos") + F.col("_shift"))
    inside = Window.partitionBy("_pid", *keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    for o, c in totals.items():
        joined = joined.withColumn(o, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{o}"))
    return joined.select(*df.columns, out, *totals)


def looked_up(rows: DataFrame, found: DataFrame, key: str, weight: str, spread: str, how: str = "inner", bare: str | None = None, needed=None) -> DataFrame:
    """``rows`` with the columns of ``found(key, weight, ...)``, one row a key, where ``weight`` is the key's number of rows.

    Keys that hold more than a quarter of an even share of all weight are heavy: there are at most four a shuffle
    partition, so they are broadcast and their rows do not move to them. All other keys are joined by a shuffle, in
    which rows that are done or have no key spread by the column ``spread``. ``how``: inner or left. Rows of heavy keys
    move without the column ``bare`` (null from then on) unless ``needed(struct of found's other columns)`` holds.
    """
    n = 4 * partitions(rows.sparkSession)
    total = found.agg(F.sum(weight)).first()[0] or 0
    heavy = F.broadcast(found.where(F.col(weight) * n > total).select(F.col(key).alias("_hot"), F.struct(*[c for c in found.columns if c != key]).alias("_by_hot")))
    rest = found.select(F.col(key).alias("_key"), F.lit(-1).alias("_at"), F.struct(*[c for c in found.columns if c != key]).alias("_by_key")).where(F.col(weight) * n <= total)
    done = F.col("_hot").isNotNull() | F.col(key).isNull()
    rows = rows.join(heavy, rows[key] == F.col("_hot"), "left")
    if bare:
        rows = rows.withColumn(bare, F.when(F.col("_by_hot").isNull() | needed(F.col("_by_hot")), F.col(bare)))
    rows = rows.withColumn("_to", F.when(~done, F.col(key))).withColumn("_spread", F.when(done, F.pmod(F.xxhash64(spread), F.lit(64 * n))).otherwise(-1).cast("int"))
    # Both parts of the key are compared null-safely, so that rows without a key do not meet in one partition.
    rows = rows.join(rest, F.col("_to").eqNullSafe(F.col("_key")) & (F.col("_spread") == F.col("_at")), "left")
    if how == "inner":
        rows = rows.where(F.col("_by_hot").isNotNull() | F.col("_by_key").isNotNull())
    names = [c for c in found.columns if c != key]
    kept = [c for c in rows.columns if c not in ("_hot", "_by_hot", "_key", "_at", "_by_key", "_to", "_spread")]
    return rows.select(*kept, *[F.coalesce(F.col("_by_hot")[c], F.col("_by_key")[c]).alias(c) for c in names])


def exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whole numbers as text: pandas holds them with nulls as floats, which are exact to 2**53 only."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("string") for c in columns if kinds[c] in ("bigint", "int", "smallint", "tinyint")})


def restored(df: DataFrame, like: DataFrame, columns: list[str]) -> DataFrame:
    """Columns back in the types they have in ``like``."""
    kinds = dict(like.dtypes)
    return df.withColumns({c: F.col(c).cast(kinds[c]) for c in columns})


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
