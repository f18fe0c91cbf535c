"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts.session import scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors, and frees the shuffle files of the step once it is written.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark, rows: int = 1000) -> None:
    """Lower the session's Arrow batch size: a batch of the default 10,000 long texts is too much for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: str | Column) -> Column:
    """True for the rows no classifier may learn from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``(_text, _label)`` of at most ``max_rows`` labelled rows of each class, in order of a hash of their id.

    Rows without id or label and held-out rows are skipped; of an id's repeated labels the highest counts.
    """
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label")))
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * max_rows ids and labels
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_text", "_label")


def slices(pdf, column: str, size: int = 1 << 21):
    """Row ranges of a pandas frame with about ``size`` characters of text each, to bound what a task holds."""
    start, total = 0, 0
    for i, text in enumerate(pdf[column]):
        total += len(text or "")
        if total >= size:
            yield pdf.iloc[start:i + 1]
            start, total = i + 1, 0
    if start < len(pdf):
        yield pdf.iloc[start:]
