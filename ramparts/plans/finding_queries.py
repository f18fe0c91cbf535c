"""Queries over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ramparts.operators import memory as mem
from ramparts.operators import rule_rows, secrets, surface, triage
from ramparts.plans.catalog import long, query
from ramparts.plans.surface_queries import assets, captures, cookies, web
from ramparts.session import materialize
from ramparts.sources.derived import table


def judged(spark, sf):
    return triage.assign_section(table(spark, sf, "find"))


def with_known(spark, sf):
    return triage.mark_known(judged(spark, sf), table(spark, sf, "memory"), ["finding_id"])


@query
def assign_section(spark, sf):
    return judged(spark, sf).select("finding_id", "proof_kind", "signal", "proven", "section")


@query
def join_known_pattern(spark, sf):
    return with_known(spark, sf).select("finding_id", "class", "known")


@query
def win_finding_rank(spark, sf):
    return triage.finding_rank(with_known(spark, sf), ["class", "finding_id"]).select(
        "run", "finding_id", "section", "known", "severity", "rank")


@query
def finding_id(spark, sf):
    ranks = triage.finding_rank(with_known(spark, sf), ["class", "finding_id"])
    return ranks.select("run", "finding_id", triage.finding_id(F.col("rank")).alias("id"))


@query
def findings_report(spark, sf):
    return triage.findings_report(with_known(spark, sf), ["class", "finding_id"])


@query
def sink_findings_json(spark, sf):
    rows = judged(spark, sf)
    return rows.select("finding_id", triage.as_json(rows, ["class", "severity", "section", "rel", "line"]).alias("json"))


@query
def pattern_memory_merge(spark, sf):
    merged = mem.merge_memory(table(spark, sf, "memory"), judged(spark, sf).filter("section = 'confirmed' and class <> 'class-view'"),
                              F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return merged


@query
def agg_section_counts(spark, sf):
    return triage.section_counts(judged(spark, sf))


@query
def agg_ci_gate(spark, sf):
    return triage.ci_gate(judged(spark, sf).withColumn("run", F.col("rel")))


@query
def agg_confirmed_classes(spark, sf):
    return triage.confirmed_classes(judged(spark, sf))


@query
def agg_high_critical(spark, sf):
    return triage.grave_counts(table(spark, sf, "find"))


@query
def top_findings_per_page(spark, sf):
    return triage.top_findings(table(spark, sf, "find"), 5, tie=["finding_id"]).select(
        "rel", "finding_id", "severity", long("rank"))


@query
def dedup_findings(spark, sf):
    return triage.dedup_findings(table(spark, sf, "find").select("finding_id", "run", "class", "severity", "rel", "evidence"),
                                 ["finding_id"], scope=["run"])


@query
def union_detectors(spark, sf):
    shown = ["detector_id", "rel", "class", "severity", "summary", "evidence"]
    headers = surface.scan_captures(captures(spark, sf), only=[
        "missing_headers", "missing_hsts", "clickjacking", "version_disclosure", "permissive_cors"])
    cookie = surface.insecure_cookies(cookies(spark, sf))
    pages = surface.scan_captures(web(spark, sf), only=[
        "mixed_content", "credentials_over_http", "sensitive_urls", "directory_listings", "verbose_errors"])
    probed = surface.scan_captures(assets(spark, sf), only=["bundle_secrets", "sensitive_paths"])
    docs = secrets.provider_findings(table(spark, sf, "sdoc"), "text", F.concat(F.lit("doc/"), F.col("doc_id")), ["doc_id"])
    return triage.union_findings([part.select(*shown) for part in (headers, cookie, pages, probed, docs)])


@query
def prove_regex(spark, sf):
    stored = secrets.provider_secrets(table(spark, sf, "sdoc"), "text", ["doc_id"])
    aged = stored.withColumn("value", F.when(F.col("doc_id") % 20 > 9, F.left("match", F.lit(9))).otherwise(F.col("match")))
    renamed = aged.withColumn("rule", F.when(F.col("doc_id") % 30 == 1, F.lit("retired rule")).otherwise(F.col("rule")))
    return triage.prove_regex(renamed).select("doc_id", "rule", "value", "proven")


@query
def secret_report(spark, sf):
    """The first full path: detect, locate, redact, prove, section and rank."""
    docs = table(spark, sf, "sdoc")
    place = F.concat(F.lit("doc/"), F.col("doc_id"))
    shown = ["rel", "class", "severity", "section", "line", "col", "summary", "evidence"]
    found = triage.union_findings([
        secrets.located_provider_findings(docs, "text", place, ["doc_id"]).select(*shown),
        secrets.assignment_findings(docs, "text", place, ["doc_id"]).select(*shown)])
    marked = found.withColumn("known", F.lit(False)).withColumn("run", F.lit("all"))
    ranks = triage.finding_rank(marked, ["col", "summary", "evidence"])
    return ranks.select("rel", "class", "severity", "section", long("line"), long("col"), "summary", "evidence",
                        "rank", triage.finding_id(F.col("rank")).alias("id"))


@query
def rule_rows_scan(spark, sf):
    """The provider rules, run from a stored table of rule rows."""
    stored = materialize(rule_rows.own_rules(spark), "rules")
    found = rule_rows.rule_findings(table(spark, sf, "sdoc"), rule_rows.load_rules(stored), "text", F.concat(F.lit("doc/"), F.col("doc_id")), ["doc_id"])
    return found.select("rel", "class", "severity", "section", long("line"), long("col"), "summary", "evidence")
