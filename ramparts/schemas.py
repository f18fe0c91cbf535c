"""Fixed schemas, and the one constructor every detector uses for its findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts import rules

CODE_FILES = "repo string, rel string, code string, unit string"
HTTP_CAPTURES = ("capture_id bigint, url string, request_origin string, status int, headers map<string,string>, "
                 "set_cookies array<string>, body string, fetched_at timestamp")
PATTERN_MEMORY = "class string, signature string, first_seen timestamp, last_seen timestamp"
PROOF = "struct<kind: string, check: string, value: string, steps: array<string>>"
REMEDIATION = "struct<before: string, after: string, contract: string, applyable: boolean>"
FINDING_COLUMNS = ["detector_id", "class", "severity", "section", "proven", "known", "unit", "rel", "line", "col",
                   "summary", "impact", "evidence", "remediation", "proof"]


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(*, detector_id, cls, severity, rel, summary, evidence, impact="", unit="http-surface", line=0, col=0,
            signal=True, kind="repro", check=None, value=None, steps=None, before=None, after=None, contract=None,
            applyable=False) -> Column:
    """One finding as a struct with the common fields.

    ``signal`` decides the section: a proof that fired, or clear evidence such as taint.
    """
    proven = F.when(as_column(signal), F.lit(True)) if kind == "repro" else as_column(signal)
    listed = F.array(*[as_column(s) for s in steps]) if steps else F.array().cast("array<string>")
    return F.struct(
        as_column(detector_id).alias("detector_id"),
        as_column(cls).alias("class"),
        as_column(severity).alias("severity"),
        F.when(proven, F.lit("confirmed")).otherwise("unconfirmed").alias("section"),
        proven.alias("proven"),
        F.lit(False).alias("known"),
        as_column(unit).alias("unit"),
        as_column(rel).alias("rel"),
        as_column(line).cast("int").alias("line"),
        as_column(col).cast("int").alias("col"),
        as_column(summary).alias("summary"),
        as_column(impact).alias("impact"),
        as_column(evidence).alias("evidence"),
        F.struct(as_column(before).cast("string").alias("before"), as_column(after).cast("string").alias("after"),
                 as_column(contract).cast("string").alias("contract"),
                 as_column(applyable).alias("applyable")).alias("remediation"),
        F.struct(F.lit(kind).alias("kind"), as_column(check).cast("string").alias("check"),
                 as_column(value).cast("string").alias("value"), listed.alias("steps")).alias("proof"),
    )


def findings(df: DataFrame, *, keep: list[str] | None = None, **fields) -> DataFrame:
    """One finding per row of ``df``; columns nobody reads are pruned by the optimizer."""
    extra = _extra(keep)
    return df.select(*extra, finding(**fields).alias("_f")).select(*extra, "_f.*")


def _extra(keep: list[str] | None) -> list[str]:
    """Columns to carry along; those every finding has anyway are left out."""
    return [c for c in (keep or []) if c not in FINDING_COLUMNS]


def emit(df: DataFrame, per_row: list[Column], keep: list[str] | None = None) -> DataFrame:
    """Findings of row-level rules, each an array of structs where null means no finding.

    All rules given together share one pass over ``df``.
    """
    every = F.array_compact(F.concat(*per_row) if len(per_row) > 1 else per_row[0])
    # the outer form evaluates the rules once per row, see explode_once
    return df.select(*_extra(keep), F.inline_outer(every)).filter(F.col("detector_id").isNotNull())


def severity_rank(severity: Column) -> Column:
    """0 for Critical to 4 for Informational; unknown severities come last."""
    rank = F.lit(None)
    for place, name in reversed(list(enumerate(rules.SEVERITIES))):
        rank = F.when(severity == name, F.lit(place)).otherwise(rank)
    return F.coalesce(rank, F.lit(rules.UNKNOWN_SEVERITY_RANK))
