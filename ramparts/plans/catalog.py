"""The registered queries: each wires one operator to a given or derived table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def long(column: str):
    return F.col(column).cast("bigint").alias(column)


def all_queries() -> dict[str, Query]:
    from ramparts.plans import (  # noqa: F401
        code_queries, fact_queries, finding_queries, stream_queries, surface_queries, text_queries)
    return dict(QUERIES)
