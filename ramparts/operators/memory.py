"""Pattern memory: which classes earlier runs confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ramparts import rules, schemas


def load_memory(spark: SparkSession, path: str) -> DataFrame:
    """The stored memory; a missing one is empty, any other fault is an error."""
    try:
        return spark.read.schema(schemas.PATTERN_MEMORY).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.PATTERN_MEMORY)


def signature_of(cls: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in rules.SIGNATURES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, cls), F.concat(F.lit("confirmed pattern of "), cls))


def merge_memory(memory: DataFrame, confirmed: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """New version of the memory: one row per class, refreshed where the class was confirmed again.

    Confirmed findings shrink to their distinct classes before the join. They are dated
    ``seen_at``, or carry their dates in ``_seen``.
    """
    fresh = confirmed.select("class").distinct().withColumn("_seen", seen_at) if seen_at is not None else confirmed
    merged = memory.join(fresh, "class", "full")
    return merged.select(
        "class",
        F.when(F.col("_seen").isNotNull(), signature_of(F.col("class"))).otherwise(F.col("signature")).alias("signature"),
        F.coalesce("first_seen", "_seen").alias("first_seen"),
        F.coalesce("_seen", "last_seen").alias("last_seen"))


def write_memory(memory: DataFrame, path: str) -> None:
    """Write a new version; the caller points readers to it, so a failed write harms nobody."""
    memory.write.mode("errorifexists").parquet(path)
