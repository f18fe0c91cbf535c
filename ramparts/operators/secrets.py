"""Credential detectors over any text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.functions import text
from ramparts.schemas import findings


def may_hold_provider(body: Column) -> Column:
    test = F.lit(False)
    for hint in rules.PROVIDER_HINTS:
        test = test | F.contains(body, F.lit(hint))
    return test


def provider_matches(body: Column) -> Column:
    """All provider matches of one text as an array of (name, match), in rule order."""
    def tagged(name: str, pattern: str) -> Column:
        return F.transform(text.find_all(body, pattern), lambda m: F.struct(F.lit(name).alias("name"), m.alias("match")))

    per_rule = [tagged(name, pattern) for name, pattern in rules.PROVIDERS]
    return F.concat(*per_rule)


def first_provider(body: Column) -> Column:
    """The first rule that matches, with its first match; later rules are not tried. Null if none."""
    chain = None
    for name, pattern in rules.PROVIDERS:
        hit = F.struct(F.lit(name).alias("name"), F.regexp_extract(body, pattern, 0).alias("match"))
        chain = F.when(body.rlike(pattern), hit) if chain is None else chain.when(body.rlike(pattern), hit)
    return F.when(may_hold_provider(body), chain)


def provider_secrets(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """One row per provider match. A single cheap test skips texts that hold none."""
    hits = text.explode_once(df.filter(may_hold_provider(F.col(body))), keep, provider_matches(F.col(body)), "_m")
    return hits.select(*keep, F.col("_m.name").alias("rule"), F.col("_m.match").alias("match"))


def provider_findings(df: DataFrame, body: str, rel: Column, keep: list[str]) -> DataFrame:
    hits = provider_secrets(df, body, keep)
    return findings(hits, detector_id="secrets", cls="Hardcoded Secret", severity="Critical", rel=rel, unit="text",
                    summary=F.concat(F.col("rule"), F.lit(" in text")), evidence=text.redact(F.col("match")),
                    impact="Anyone who can read the text can use the credential.",
                    kind="runnable", check="regex", value=F.col("match"), keep=keep)


def assigned_secrets(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """One row per quoted literal assigned to a secret-named variable, with its line and column."""
    found = text.match_evidence(df, body, rules.SECRET_ASSIGNMENT, keep, hint=rules.ASSIGNMENT_HINT)
    quoted = F.coalesce(text.first_match(F.col("match"), rules.SECRET_ASSIGNMENT, 1),
                        text.first_match(F.col("match"), rules.SECRET_ASSIGNMENT, 2))
    return found.withColumn("literal", quoted)


def assignment_findings(df: DataFrame, body: str, rel: Column, keep: list[str], reported_by_provider: bool = True) -> DataFrame:
    """Findings of assigned literals; without ``reported_by_provider``, literals that a provider rule reports are left to it."""
    hits = assigned_secrets(df, body, keep)
    if not reported_by_provider:
        hits = hits.filter(first_provider(F.col("literal")).isNull())
    return findings(hits, detector_id="secrets", cls="Hardcoded Secret", severity="High", rel=rel, unit="text",
                    summary="literal assigned to a secret-named variable", evidence=text.redact(F.col("literal")),
                    line=F.col("line"), col=F.col("col"), signal=False,
                    impact="A credential kept in source reaches everyone with read access.", keep=keep)


@text.per_application
def _located_providers() -> Column:
    """All provider matches of ``_line`` with their columns."""
    def tagged(name: str, pattern: str) -> Column:
        return F.transform(text.located(F.col("_line"), pattern, {}),
                           lambda m: F.struct(F.lit(name).alias("name"), m["col"].alias("col"), m["hit"].alias("match")))
    return F.concat(*[tagged(name, pattern) for name, pattern in rules.PROVIDERS])


def located_provider_findings(df: DataFrame, body: str, rel: Column, keep: list[str]) -> DataFrame:
    """Provider findings with line and column: the physical line is cut out first, then tested."""
    lines = text.explode_once(df.filter(may_hold_provider(F.col(body))), keep, F.split(body, "\n", -1), "_line", "_no").filter(
        may_hold_provider(F.col("_line")))

    hits = lines.select(*keep, "_no", F.inline_outer(_located_providers())).filter("name is not null")
    return findings(hits, detector_id="secrets", cls="Hardcoded Secret", severity="Critical", rel=rel, unit="text",
                    summary=F.concat(F.col("name"), F.lit(" in text")), evidence=text.redact(F.col("match")),
                    line=F.col("_no") + 1, col=F.col("col"), kind="runnable", check="regex", value=F.col("match"),
                    impact="Anyone who can read the text can use the credential.", keep=keep)
