"""Detectors as data: a table of rules, checked by name and compiled to one expression.

A rule row is either a ``match`` (one finding per place where its pattern stands in a line) or a ``sign`` (one label per
file that holds its pattern). Rows are kept by version: a scan takes one version of the table, the newest if none is
named, and gives the same findings whenever it is run again with that version. The rules never take part in a join;
all of them together are one pass over the texts. Patterns are those of the JVM and must not reach over a line break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.functions import text
from ramparts.schemas import findings

RULE_ROWS = ("version int, place int, rule_id string, detector_id string, kind string, class string, label string, severity string, "
             "pattern string, hints array<string>, proves boolean, impact string")
KINDS = ["match", "sign"]
# rules become one expression, so a version holds a bounded number of them; more is an error
MOST_RULES = 500


class RuleError(ValueError):
    """Rows of a rule table that cannot be used, each with its name and reason."""


def own_rules(spark: SparkSession, version: int = 1) -> DataFrame:
    """The provider and good-practice rules of this library as rule rows."""
    def hints(pattern: str) -> list[str]:
        # a provider pattern starts with the literal that one of the hints starts with, or holds the hint itself
        lead = pattern.split("(?<!")[0]
        return [h for h in rules.PROVIDER_HINTS if h.startswith(lead)] or [h for h in rules.PROVIDER_HINTS if h in pattern]

    rows = [(version, place, f"secret-{place}", "secrets", "match", "Hardcoded Secret", label, "Critical", pattern, hints(pattern), True,
             "Anyone who can read the text can use the credential.") for place, (label, pattern) in enumerate(rules.PROVIDERS)]
    rows += [(version, place, f"practice-{place}", "practices", "sign", None, label, None, pattern, None, None, None)
             for place, (label, pattern) in enumerate(rules.GOOD_PRACTICES, len(rows))]
    return spark.createDataFrame(rows, RULE_ROWS)


def load_rules(table: DataFrame, version: int | None = None) -> list[Row]:
    """The rules of one version in the order of ``place``, all of them usable; otherwise ``RuleError`` names the bad ones.

    An empty table has no rules; a version that is named and missing is an error. Rows without a version are refused.
    """
    rows = table.select(*[f.split()[0] for f in RULE_ROWS.split(", ")])
    chosen = rows.filter(F.col("version").isNull() | (F.col("version") == version)) if version is not None else (
        rows.join(F.broadcast(rows.agg(F.max("version").alias("_newest"))), F.col("version").isNull() | (F.col("version") == F.col("_newest"))).drop("_newest"))
    listed = chosen.limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise RuleError(f"more than {MOST_RULES} rules in one version")
    if version is not None and not listed:
        raise RuleError(f"the table has no version {version}")
    names = [r["rule_id"] for r in listed]
    faults = {}
    for number, rule in enumerate(listed):
        reason = _fault(rule, names)
        if reason:
            faults[rule["rule_id"] or f"row {number + 1} without a name"] = reason
    sound = [r for r in listed if r["rule_id"] not in faults and r["pattern"]]
    faults |= {r["rule_id"]: reason for r, reason in zip(sound, _pattern_faults(table.sparkSession, [r["pattern"] for r in sound])) if reason}
    if faults:
        raise RuleError("; ".join(f"{name}: {reason}" for name, reason in sorted(faults.items())))
    return sorted(listed, key=lambda r: (r["place"] is None, r["place"], r["rule_id"]))


def _fault(rule: Row, names: list[str]) -> str | None:
    if not rule["rule_id"]:
        return "has no rule_id"
    if rule["version"] is None:
        return "has no version"
    if names.count(rule["rule_id"]) > 1:
        return "stands there more than once"
    if rule["kind"] not in KINDS:
        return f"kind {rule['kind']} is not one of {', '.join(KINDS)}"
    if not rule["label"] or not rule["pattern"]:
        return "needs a label and a pattern"
    if rule["kind"] == "match" and rule["severity"] not in rules.SEVERITIES:
        return f"severity {rule['severity']} is not known"
    if rule["kind"] == "match" and not (rule["class"] and rule["detector_id"]):
        return "needs a class and a detector_id"
    if rule["hints"] is not None and not all(rule["hints"]):
        return "has an empty hint"
    return None


def _pattern_faults(spark: SparkSession, patterns: list[str]) -> list[str | None]:
    """Why a pattern cannot be used, by running it on the empty text: all at once, one by one only if that fails."""
    def tried(some: list[str]) -> list[str | None]:
        hits = spark.range(1).select(*[F.lit("").rlike(p).alias(f"p{n}") for n, p in enumerate(some)]).first()
        return ["matches the empty text" if hit else None for hit in hits]

    if not patterns:
        return []
    try:
        return tried(patterns)
    except PySparkException:
        if len(patterns) == 1:
            return ["its pattern does not compile"]
        half = len(patterns) // 2
        return _pattern_faults(spark, patterns[:half]) + _pattern_faults(spark, patterns[half:])


def _may_match(body: Column, chosen: list[Row]) -> Column:
    """False only where no rule can match: by its hints, each a literal of which every match holds one, else by its pattern."""
    def one(rule: Row) -> Column:
        return reduce(Column.__or__, [F.contains(body, F.lit(h)) for h in rule["hints"]]) if rule["hints"] else body.rlike(rule["pattern"])
    return reduce(Column.__or__, [one(r) for r in chosen])


def rule_findings(df: DataFrame, chosen: list[Row], body: str, rel: Column, keep: list[str]) -> DataFrame:
    """Findings of the ``match`` rules with line and column; ``proves`` decides whether a match is confirmed by itself."""
    matching = [r for r in chosen if r["kind"] == "match"]

    def tagged(place: int, rule: Row) -> Column:
        found = F.transform(text.located(F.col("_line"), rule["pattern"], {}),
                            lambda m: F.struct(F.lit(place).alias("_rule"), m["col"].alias("_col"), m["hit"].alias("_hit")))
        return F.when(_may_match(F.col("_line"), [rule]), found).otherwise(F.array().cast("array<struct<_rule: int, _col: int, _hit: string>>"))

    def field(name: str) -> Column:
        return F.element_at(F.array(*[F.lit(r[name]).cast("string") for r in matching]), F.col("_rule") + 1)

    if not matching:
        nothing = F.lit(None).cast("string")
        hits = df.filter("false").select(*keep, F.lit(0).alias("_no"), F.lit(0).alias("_col"), nothing.alias("_hit"))
        detector_id = cls = severity = label = impact = nothing
        proves = F.lit(None).cast("boolean")
    else:
        lines = text.explode_once(df.filter(_may_match(F.col(body), matching)), keep, F.split(body, "\n", -1), "_line", "_no")
        hits = lines.select(*keep, "_no", F.inline_outer(F.concat(*[tagged(n, r) for n, r in enumerate(matching)]))).filter("_rule IS NOT NULL")
        detector_id, cls, severity, label, impact = (field(n) for n in ("detector_id", "class", "severity", "label", "impact"))
        proves = F.coalesce(F.element_at(F.array(*[F.lit(r["proves"]).cast("boolean") for r in matching]), F.col("_rule") + 1), F.lit(False))
    return findings(hits, detector_id=detector_id, cls=cls, severity=severity, rel=rel, unit="text",
                    summary=F.concat(label, F.lit(" in text")), evidence=text.redact(F.col("_hit")), line=F.col("_no") + 1, col=F.col("_col"),
                    signal=proves, kind="runnable", check="regex", value=F.col("_hit"), impact=F.coalesce(impact, F.lit("")), keep=keep)


def rule_signs(df: DataFrame, chosen: list[Row], body: str, keep: list[str]) -> DataFrame:
    """(label, *keep) for every ``sign`` rule whose pattern a text holds."""
    labels = [F.when(_may_match(F.col(body), [r]) & F.col(body).rlike(r["pattern"]), F.lit(r["label"])) for r in chosen if r["kind"] == "sign"]
    found = F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>")
    return df.select(F.explode(found).alias("label"), *keep)
