"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks. DataFrame operations only.

Targets are filled like water by weight up to a cap. Blocks of ``block`` words go to the sources by highest
quotients ``target / (2 n + 1)``; the same rule deals a source's blocks to its shards. A shard orders its
documents by a seeded hash, lays them end to end, and takes its quota as whole passes plus a run of blocks
that starts at a seeded place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramparts.llm.common import stored, whole

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 16
SHARD_WORDS = 200_000
SEED = 11


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.size(F.filter(F.split(whole(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source, null last.

    Sources by code point take the weights in turn and share ``share`` of all sizes; what exceeds ``cap``
    times a source's size is shared again by weight until no target is above. The level at which this ends
    is found by one pass over the sources in order of cap per weight.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * cap)
    everyone = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("total", F.sum("source_size").over(everyone) * F.lit(share)).withColumn("weights", F.sum("weight").over(everyone))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(filled), F.lit(0)))
                        / (F.col("weights") - F.coalesce(F.sum("weight").over(filled), F.lit(0)))))
    # the running level rises while sources are full at it and falls after: the final one is the highest that fits
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everyone)
    return rows.select("source", "source_size", F.when(level.isNull(), F.col("cap").cast("double"))
                       .otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight"))).alias("target"))


def apportion(units: DataFrame, group: list[str], order: list[str], votes: str, seats: str, out: str = "quota") -> DataFrame:
    """Sainte-Laguë: ``seats`` of each ``group`` go to its units by highest ``votes / (2 n + 1)``.

    Highest quotients never move a unit by more than half its share times the number of units from its
    rounded share, so only the quotients of that span are ranked. Ties go by ``order``. No votes, no seats.
    """
    of = Window.partitionBy(*group)
    span = units.withColumn("_all", F.sum(votes).over(of)).withColumn("_units", F.count("*").over(of))
    per = F.col(votes) / F.col("_all")
    low = F.when(F.col("_all") > 0, F.greatest(F.lit(0), F.floor(per * (F.col(seats) - F.col("_units") / 2) - 1.5))).otherwise(F.lit(0)).cast("long")
    high = F.when(F.col("_all") > 0, F.ceil(per * (F.col(seats) + F.col("_units") / 2) + 1.5)).otherwise(F.lit(0)).cast("long")
    span = span.withColumn("_low", low).withColumn("_high", high)
    span = span.withColumn("_left", F.col(seats) - F.sum("_low").over(of))
    quotients = (span.filter(F.col(votes) > 0).withColumn("_n", F.explode(F.sequence("_low", "_high")))
                 .withColumn("_q", F.col(votes) / (2 * F.col("_n") + 1)))
    best = Window.partitionBy(*group).orderBy(F.desc("_q"), *(F.asc(c) for c in order), "_n")
    keys = [*group, *order]
    won = (quotients.withColumn("_rank", F.row_number().over(best)).filter("_rank <= _left")
           .groupBy(*(F.col(c).alias(f"_of_{c}") for c in keys)).agg(F.count("*").alias("_won")))
    match = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return span.join(won, match, "left").select(*units.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias(out))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, cap: int = CAP, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` per row of ``docs``.

    ``taken`` counts the words the mix takes from a document, repeats included: at most ``cap`` times its size.
    A source's ``taken`` adds up to its target within a block per shard. The result depends on rows and seed
    only. A null source is a source of its own, after all others; a null text has size 0; null ids and
    repeated rows count as rows each. No words at all: all targets and ``taken`` are 0. An empty table gives
    no rows. Other columns are not read.
    """
    id_hash = F.xxhash64(F.col(id_col), F.lit(seed))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
                              id_hash.alias("place"), F.xxhash64(text_col).alias("tie")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stored(targets(sizes, weights, share, cap), "targets")
    total = Window.partitionBy()
    blocks = goal.withColumn("one", F.lit(0)).withColumn("all_blocks", F.round(F.sum("target").over(total) / block).cast("long"))
    blocks = apportion(blocks, ["one"], ["source"], "target", "all_blocks", "blocks")
    blocks = blocks.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int")).drop("one", "all_blocks")
    blocks = stored(blocks.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "blocks").alias("b")
    named = rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source").join(blocks, "name")
    named = stored(named.withColumn("shard", F.pmod(F.xxhash64("place", F.lit(seed)), F.col("shards")).cast("int")), "shards")
    shard_sizes = named.groupBy("name", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    quota = apportion(shard_sizes, ["name"], ["shard"], "words", "blocks").select("name", "shard", "words", "quota")
    per_shard = (quota.withColumn("ring", F.ceil(F.col("words") / block).cast("long"))
                 .withColumn("quota", F.least(F.col("quota"), F.col("ring") * cap))
                 .withColumn("passes", F.when(F.col("ring") > 0, F.floor(F.col("quota") / F.col("ring"))).otherwise(F.lit(0)))
                 .withColumn("more", F.when(F.col("ring") > 0, F.col("quota") % F.col("ring")).otherwise(F.lit(0)))
                 .withColumn("first", F.when(F.col("ring") > 0, F.pmod(F.xxhash64("name", "shard", F.lit(seed)), F.col("ring"))).otherwise(F.lit(0))))
    line = Window.partitionBy("name", "shard").orderBy("place", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = named.withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0))).join(per_shard.drop("words"), ["name", "shard"])
    begin, end = F.col("first") * block, (F.col("first") + F.col("more")) * block
    around = F.greatest(F.lit(0), F.col("first") + F.col("more") - F.col("ring")) * block

    def overlap(low, high):
        return F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), high) - F.greatest(F.col("at"), low))
    once = overlap(begin, F.least(end, F.col("ring") * block)) + overlap(F.lit(0), around)
    return laid.select("doc_id", "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + once).cast("long").alias("taken"))
