"""Findings after detection: sections, proof, known patterns, order, counts and the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.schemas import severity_rank
from ramparts.session import lookup_join, ranked


def union_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dedup_findings(findings: DataFrame, order: list[str], scope: list[str] | None = None) -> DataFrame:
    """Keep the first finding per (class, evidence), within ``scope`` if given.

    ``order`` must be unique. The aggregation keeps one row per key and task before the shuffle,
    so a finding repeated a billion times costs no more than a rare one.
    """
    keys = [*(scope or []), "class", "evidence"]
    rest = [c for c in findings.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return findings.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*findings.columns)


def proven(kind: Column, signal: Column) -> Column:
    """Runnable proofs say true or false; reproduction steps only ever say true or unknown."""
    return F.when(kind == "runnable", signal).when(signal, F.lit(True))


def assign_section(findings: DataFrame, kind: str = "proof_kind", signal: str = "signal") -> DataFrame:
    """Add ``proven`` and ``section``: confirmed if and only if proven is true."""
    judged = findings.withColumn("proven", proven(F.col(kind), F.col(signal)))
    return judged.withColumn("section", F.when(F.col("proven"), "confirmed").otherwise("unconfirmed"))


def prove_regex(findings: DataFrame, rule: str = "rule", value: str = "value") -> DataFrame:
    """Test each stored value against the pattern its rule has today; unknown rules stay unknown."""
    test = None
    for name, pattern in rules.PROVIDERS:
        hit = F.col(value).rlike(pattern)
        test = F.when(F.col(rule) == name, hit) if test is None else test.when(F.col(rule) == name, hit)
    return findings.withColumn("proven", test)


def mark_known(findings: DataFrame, memory: DataFrame, salt_by: list[str], broadcast_rows: int | None = None) -> DataFrame:
    """Flag findings whose class is remembered from earlier runs."""
    extra = {} if broadcast_rows is None else {"broadcast_rows": broadcast_rows}
    remembered = memory.select("class").distinct().withColumn("_known", F.lit(True))
    plain = findings.drop("known")
    return (lookup_join(plain, remembered, ["class"], salt_by=salt_by, **extra)
            .withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known"))


def finding_rank(findings: DataFrame, tie: list[str], run: str = "run") -> DataFrame:
    """Running number per run: confirmed first, then known classes, then severity, then place."""
    order = [(F.col("section") != "confirmed").asc(), F.col("known").desc(), severity_rank(F.col("severity")).asc(),
             F.col("rel").asc(), F.col("line").asc(), *[F.col(t).asc() for t in tie]]
    return ranked(findings, [run], order)


def finding_id(rank: Column) -> Column:
    digits = rank.cast("string")
    return F.concat(F.lit("F-"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def top_findings(findings: DataFrame, k: int, page: str = "rel", tie: list[str] | None = None) -> DataFrame:
    """The ``k`` gravest findings per page; each task already keeps only its own best ``k``."""
    order = Window.partitionBy(page).orderBy(severity_rank(F.col("severity")), "class", "evidence", *(tie or []))
    return findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def section_counts(findings: DataFrame, run: str = "run") -> DataFrame:
    return findings.groupBy(run, "section").agg(F.count("*").alias("n"))


def is_grave() -> Column:
    return F.col("severity").isin("Critical", "High")


def ci_gate(findings: DataFrame, run: str = "run") -> DataFrame:
    """A run fails if any confirmed finding is Critical or High."""
    return findings.groupBy(run).agg(F.bool_or((F.col("section") == "confirmed") & is_grave()).alias("failed"))


def confirmed_classes(findings: DataFrame) -> DataFrame:
    return findings.filter("section = 'confirmed'").select("class").distinct()


def grave_counts(findings: DataFrame, page: str = "rel") -> DataFrame:
    return findings.groupBy(page).agg(F.count("*").alias("total"), F.count_if(is_grave()).alias("grave"))


def findings_report(findings: DataFrame, tie: list[str], run: str = "run") -> DataFrame:
    """The report as a table: running id, place, flags, and the size of the section it belongs to."""
    numbered = finding_rank(findings, tie, run)
    counts = section_counts(findings, run).withColumnRenamed("n", "section_size")
    keyed = [run, "section"]
    sized = lookup_join(numbered, counts, keyed, salt_by=tie)
    return sized.select(
        run, "section", finding_id(F.col("rank")).alias("id"), "class", "severity", "known",
        F.concat_ws(":", "rel", F.col("line").cast("string")).alias("location"), "section_size")


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.json(path)


def write_report(report: DataFrame, path: str, run: str = "run") -> None:
    report.write.partitionBy(run).parquet(path)


def as_json(findings: DataFrame, columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))
