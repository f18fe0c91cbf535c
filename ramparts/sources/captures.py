"""HTTP capture source: crawl records with normalized headers and whole bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramparts import schemas
from ramparts.functions.http import cookie_values, normalized_headers


def cap_body(body: Column, chars: int | None = None) -> Column:
    """The whole body, or its first ``chars`` characters."""
    return body if chars is None else F.substring(body, 1, chars)


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return prepare_captures(spark.read.schema(schemas.HTTP_CAPTURES).format(fmt).load(path))


def prepare_captures(raw: DataFrame) -> DataFrame:
    """Lower-case the header names, move Set-Cookie headers to their list."""
    return (raw.withColumn("set_cookies", F.concat(F.coalesce("set_cookies", F.array().cast("array<string>")),
                                                   F.coalesce(cookie_values(F.col("headers")), F.array().cast("array<string>"))))
            .withColumn("headers", normalized_headers(F.col("headers")))
            .withColumn("body", cap_body(F.col("body"))))


def flat_headers(columns: dict[str, str]) -> Column:
    """A header map from flat columns, given as header name -> column; nulls are left out."""
    entries = F.array(*[F.struct(F.lit(h).alias("key"), F.col(c).alias("value")) for h, c in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
