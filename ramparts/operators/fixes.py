"""Fix suggestions and their batch application to the code table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.session import BROADCAST_ROWS, lookup_join


def suggest_fixes(findings: DataFrame, keep: list[str]) -> DataFrame:
    """One before/after row per finding that carries a rewrite."""
    return findings.filter("remediation.before is not null and remediation.after is not null").select(
        *keep, "class", "line", F.col("remediation.before").alias("before"), F.col("remediation.after").alias("after"),
        F.col("remediation.applyable").alias("applyable"))


def apply_fixes(files: DataFrame, fixes: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """New version of the code table (file_id, code) with the number of applied and conflicting fixes.

    The fixes of a file are applied one after the other, in line order: each replaces the first
    place where its ``before`` still stands, and is a conflict if there is none or if it may not be
    applied by machine. A file has no more fixes than lines, so its list stays small.
    """
    listed = fixes.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line", "before", "after", "applyable"))).alias("fixes"))
    joined = lookup_join(files, listed, ["file_id"], ["file_id"], broadcast_rows=broadcast_rows)
    start = F.struct(F.col("code").alias("code"), F.lit(0).cast("bigint").alias("applied"), F.lit(0).cast("bigint").alias("conflicts"))

    def step(acc, fix):
        at = F.when(fix["applyable"], F.position(fix["before"], acc["code"])).otherwise(F.lit(0))
        rest = F.substring(acc["code"], at + F.length(fix["before"]), F.length(acc["code"]))
        changed = F.concat(F.left(acc["code"], at - 1), fix["after"], rest)
        return F.struct(F.when(at > 0, changed).otherwise(acc["code"]).alias("code"),
                        (acc["applied"] + (at > 0).cast("bigint")).alias("applied"),
                        (acc["conflicts"] + (at <= 0).cast("bigint")).alias("conflicts"))

    none = F.array().cast("array<struct<line: int, before: string, after: string, applyable: boolean>>")
    done = joined.withColumn("_done", F.aggregate(F.coalesce("fixes", none), start, step))
    return done.drop("fixes", "code").select("*", "_done.*").drop("_done")
