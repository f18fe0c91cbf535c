"""Header and cookie expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_headers(headers: Column) -> Column:
    """Lower-cased header names without Set-Cookie; of two spellings the last one wins."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    kept = F.filter(pairs, lambda e: e["key"] != "set-cookie")
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def cookie_values(headers: Column) -> Column:
    return F.transform(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "set-cookie"), lambda e: e["value"])


def header(headers: Column, name: str) -> Column:
    """A header value, null if it is missing or empty."""
    return F.nullif(headers[name], F.lit(""))
