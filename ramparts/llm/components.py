"""Connected components of an edge table, as joins and aggregates (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v.

    Large: every neighbour above a node links to the smallest of its neighbours and itself.
    Small: every neighbour below a node, and the node, link to the smallest of them.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        made = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        made = edges.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
                                                             F.struct(F.col("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v")
    return made.filter("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node with an edge; ``root`` is the smallest node of its component.

    The number of rounds follows the logarithm of the longest path. Each round is written to the shared
    folder; only a count and a checksum come to the driver. A null end or a loop makes no edge; an empty
    table gives an empty result. Raises if ``rounds`` do not settle it.
    """
    edges = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                   .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        edges = stored(_star(_star(edges, True), False), "edges")
        after = _state(edges)
        if after == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select("root", "root").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")
