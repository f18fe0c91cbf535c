"""Corpus pipeline: documents in, mixed documents out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage's result to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ramparts.llm import decontaminate, mixing, simhash, suffix_dedup, toxicity
from ramparts.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity classifier does not reject."""
    docs = docs.select(*COLUMNS)
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one with the smallest id.

    Of repeated rows one stays. Documents without id form groups like others; such a group keeps one row.
    """
    marked = docs.select(*COLUMNS).withColumn("_tie", F.xxhash64("text", "lang", "source", "n_chars"))
    groups = simhash.near_duplicates(marked)
    no_id = F.col("component_id").isNull()
    # a group that has an id is represented by its smallest; one without ids by its fingerprint alone
    keep = groups.filter("id = component_id").select("id").distinct()
    named = marked.join(keep.withColumnRenamed("id", "doc_id"), "doc_id")
    one = Window.partitionBy("doc_id").orderBy("_tie")
    named = named.withColumn("_n", F.row_number().over(one)).filter("_n = 1").select(*COLUMNS)
    lone = groups.filter(no_id).select("fp").distinct()
    unnamed = marked.filter("doc_id IS NULL").withColumn("fp", simhash.fingerprints()(F.col("text"))).join(lone, "fp")
    unnamed = unnamed.withColumn("_n", F.row_number().over(Window.partitionBy("fp").orderBy("_tie"))).filter("_n = 1").select(*COLUMNS)
    return named.unionByName(unnamed)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages from the texts; what remains of a document stays, an empty rest goes."""
    rest = suffix_dedup.dedup_passages(docs, columns=("kept_text", "n_removed"), carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return (rest.filter("n_removed = 0 OR trim(kept_text) != ''")
            .select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without benchmark passages."""
    docs = docs.select(*COLUMNS)
    return decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take from each document for the target weights of its source."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeated passages", drop_repeats), ("benchmark leaks", drop_leaks),
          ("mix", mix_sources)]

# Learned scores, hashes of shingles and bytes cannot be written in SQL: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
