"""Queries that run as streams over the given files until everything is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ramparts.operators import surface, triage
from ramparts.plans.catalog import query
from ramparts.plans.surface_queries import _HEADER_COLUMNS
from ramparts.sources.captures import flat_headers
from ramparts.sources.derived import SQL, table
from ramparts.streaming import flows


def streamed(spark, sf, base: str, name: str) -> DataFrame:
    """A derived table over the stream of the given table ``base``."""
    flows.read_stream(spark, sf, f"{base}.parquet").createOrReplaceTempView(base)
    return spark.sql(SQL[name])


@query
def stream_captures(spark, sf):
    captures = streamed(spark, sf, "pages", "cap").withColumn("headers", flat_headers(_HEADER_COLUMNS))
    found = surface.scan_captures(captures, only=["missing_headers", "missing_hsts", "clickjacking", "version_disclosure", "permissive_cors"])
    return flows.run_append(found.select("rel", "class", "severity", "summary", "evidence"), "captures")


@query
def stream_latest_tab(spark, sf):
    return flows.latest_tabs_stream(streamed(spark, sf, "events", "tab_load"))


@query
def stream_dedup(spark, sf):
    flows.read_stream(spark, sf, "events.parquet").createOrReplaceTempView("events")
    findings = spark.sql(SQL["find"].replace("SELECT event_id AS finding_id", "SELECT CAST(ts AS TIMESTAMP) AS ts, event_id AS finding_id"))
    return flows.dedup_exactly(findings, ["run", "class", "evidence"]).select("run", "class", "evidence")


@query
def stream_merge_dom_headers(spark, sf):
    captures = streamed(spark, sf, "pages", "cap").withColumn("headers", flat_headers(_HEADER_COLUMNS)).withColumnRenamed("capture_id", "tab_id")
    pages = streamed(spark, sf, "pages", "web").withColumnRenamed("html", "body").withColumnRenamed("page_id", "tab_id")
    shown = ["tab_id", "class", "evidence"]
    merged = flows.merge_by_tab(surface.scan_captures(captures, ["tab_id"], only=["missing_hsts", "clickjacking"]).select(*shown),
                                surface.scan_captures(pages, ["tab_id"], only=["mixed_content", "credentials_over_http", "sensitive_urls"]).select(*shown))
    return flows.run_append(merged, "merged")


@query
def stream_memory(spark, sf):
    flows.read_stream(spark, sf, "events.parquet").createOrReplaceTempView("events")
    findings = triage.assign_section(spark.sql(SQL["find"].replace("SELECT event_id AS finding_id", "SELECT ts, event_id AS finding_id")))
    marked, _ = flows.memory_stream(findings, table(spark, sf, "memory"), ["finding_id"])
    return marked.select("finding_id", "class", "known")
