"""The whole surface flow: captures of sites in, findings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.operators import surface, triage
from ramparts.schemas import emit

# which rules look at which captures of a site
ROLES = {
    "page": ["missing_headers", "missing_hsts", "clickjacking", "version_disclosure", "insecure_cookies", "permissive_cors", "mixed_content",
             "credentials_over_http", "sensitive_urls", "directory_listings"],
    "script": ["bundle_secrets"],
    "probe": ["sensitive_paths"],
    "error": ["verbose_errors"],
}


def scan_site(captures: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Findings of captures that carry a ``role``: page, script, probe or error.

    All row rules share one pass; only exposed source maps need a join.
    """
    shape = captures.select(surface.RULES["missing_hsts"]().alias("r")).schema["r"].dataType
    per_row = [F.when(F.col("role") == role, F.concat(*[surface.RULES[name]() for name in names])).otherwise(F.array().cast(shape))
               for role, names in ROLES.items()]
    found = emit(captures, per_row, keep)
    maps = surface.exposed_source_maps(captures.filter("role = 'script' and status = 200"), captures, keep or ["capture_id"])
    return triage.union_findings([found, maps.select(*found.columns)])

