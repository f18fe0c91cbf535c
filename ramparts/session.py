"""Session helpers: shared storage, written intermediates, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A broadcast side never holds more rows than this; beyond it the join is salted.
BROADCAST_ROWS = 50_000

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may fall back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="ramparts-")
    return _local_dirs[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage the way ``checkpoint()`` does, survives lost executors, and
    keeps the result columnar with real size statistics for the next plan.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lower the session's Arrow batch size: a batch of the default 10,000 long texts is too much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows; never reads far beyond that."""
    return df.limit(rows + 1).count() <= rows


def large(df: DataFrame) -> DataFrame:
    """``df`` as a join side that Spark must not broadcast by its own estimate.

    The estimate is the size of compressed files: tables of a few MB on disk can be hundreds of MB in the driver.
    Sides that may be broadcast are counted first and say so with ``F.broadcast``.
    """
    return df.hint("merge")


def hot_keys(df: DataFrame, on: list[str], share: int = 500) -> DataFrame:
    """Keys holding more than ``1/share`` of the rows: fewer than ``share`` of them by construction."""
    keyed = df
    for key in on:
        keyed = keyed.filter(F.col(key).isNotNull())
    counts = keyed.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") * share > total).select(*on, F.lit(True).alias("_hot"))


def salt_many(df: DataFrame, hot: DataFrame, on: list[str], salt_by: list[str], salts: int) -> DataFrame:
    """Spread the rows of hot keys over ``salts`` parts, and rows with a null key, which match nothing.

    The list of hot keys is bounded, so broadcasting it is safe.
    """
    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    return df.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | any_null, spread).otherwise(F.lit(0))).drop("_hot")


def salt_one(df: DataFrame, hot: DataFrame, on: list[str], salts: int) -> DataFrame:
    """Repeat the rows of hot keys once per part, all other rows stay single."""
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return df.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(every)).drop("_hot")


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: list[str], how: str = "left",
                broadcast_rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Equi-join of ``left`` with ``right`` that stays balanced when a left key is hot.

    A small right side is broadcast after its size was counted. Otherwise hot keys are salted:
    only their right rows are repeated. ``salt_by`` must tell left rows of one key apart and be
    deterministic, so that a task that runs again puts every row in the same place.
    """
    if broadcast_rows and is_small(right, broadcast_rows):
        return left.join(F.broadcast(right), on, how)
    # written once: both are used twice below, and each use would make the whole left side again, with all joins before it
    left = materialize(left, "lookups")
    hot = materialize(hot_keys(left, on), "hot")
    return (salt_many(left, hot, on, salt_by, salts)
            .join(large(salt_one(right, hot, on, salts)), [*on, "_salt"], how).drop("_salt"))


def ranked(df: DataFrame, group: list, order: list, out: str = "rank") -> DataFrame:
    """``row_number`` per group without ever holding a whole group in one task.

    Rows are range-partitioned on (group, order), so a hot group is cut into many ranges, sorted
    and written once. Each row then gets its position inside its range plus the sizes of the
    earlier ranges of the same group, a table with one row per (range, group). ``order`` has to
    end in a unique column, which both fixes ties and lets any group be split.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + list(order)
    placed = materialize(
        df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        .withColumn("_range", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy("_range", *group).agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return (placed.join(large(starts), ["_range", *group])
            .withColumn(out, F.col("_seq") - F.col("_first") + F.col("_before") + 1)
            .drop("_range", "_seq", "_first", "_before"))
