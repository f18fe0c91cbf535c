"""Structured Streaming forms of the detectors and of the triage steps.

State lives in Spark's state store or in versioned tables. Every flow takes ``place``, a folder for its output
and its progress: started again with the same one it goes on where it stopped, and a batch that runs again writes
the same place, so restarts neither lose nor repeat anything. Without ``place`` a run begins anew in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramparts.operators import memory as mem
from ramparts.operators import triage
from ramparts.session import scratch


def read_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Files called ``name`` in ``folder`` as a stream with the schema of the files already there.

    If no file has that name, it is the folder of a table, whose files may have any name.
    """
    try:
        schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    except AnalysisException as missing:
        if missing.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        folder, name = f"{folder}/{name}", "*"
        schema = spark.read.parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_append(rows: DataFrame, label: str, place: str | None = None) -> DataFrame:
    """Process everything available in append mode and return the table written so far."""
    spark = rows.sparkSession
    place = place or scratch(spark, label)
    stream = (rows.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/progress")
              .outputMode("append").trigger(availableNow=True).start())
    stream.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/rows")


def run_batches(rows: DataFrame, handle: Callable[[DataFrame, int], None], place: str, mode: str = "append") -> None:
    stream = (rows.writeStream.foreachBatch(handle).option("checkpointLocation", f"{place}/progress")
              .outputMode(mode).trigger(availableNow=True).start())
    stream.awaitTermination()


def newest_load() -> list:
    newest = F.struct("ts", "load_id", "url", "closed")
    return [F.max(newest).alias("newest")]


def latest_tabs(loads: DataFrame) -> DataFrame:
    """Batch form: the newest load per tab, without tabs whose newest event closed them.

    A tab's loads meet as one partial maximum per task, so a busy tab costs one row per task.
    """
    return loads.groupBy("tab_id").agg(*newest_load()).select("tab_id", "newest.*").filter("not closed").drop("closed")


def latest_tabs_stream(loads: DataFrame, place: str | None = None, late: str | None = None, buckets: int = 64) -> DataFrame:
    """Stream form: the open tabs as a stored table that every batch brings up to date, in a folder per bucket of tabs.

    A batch is reduced to the newest load per tab and rewrites only the buckets it has tabs in. Every bucket has two
    slots: a batch reads the one that the index of the batch before names and writes the other, then the index, so a
    batch that runs again sees what it saw before, and neither storage nor reading grows with the number of batches.
    Read the table between runs: a slot is written anew by the second next batch that touches its bucket.

    A closed tab leaves only its closing event, so that an older load that comes later does not open it again. With
    ``late`` (an interval such as '1 hour') closing events that far behind the newest event seen go when their
    bucket is next written; None keeps them, and the table equals the batch form whatever the order.
    """
    spark = loads.sparkSession
    place = place or scratch(spark, "tabs")
    rows, index = f"{place}/tabs", f"{place}/index"
    shape = loads.select("tab_id", "ts", "load_id", "url", "closed").schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    stored = f"{columns}, filled boolean"
    kept = "bucket int, slot int, batch bigint, newest_ts " + shape["ts"].dataType.simpleString()
    bucket = F.pmod(F.xxhash64("tab_id"), F.lit(buckets)).cast("int")

    def slots(listed: list) -> DataFrame:
        paths = [f"{rows}/bucket={r['bucket']}/slot={r['slot']}" for r in listed]
        return spark.read.schema(stored).parquet(*paths).filter("filled") if paths else spark.createDataFrame([], stored)

    def handle(batch: DataFrame, number: int) -> None:
        # at most ``buckets`` rows; a batch reads the index of the one before
        before = spark.read.schema(kept).parquet(f"{index}/turn={(number + 1) % 2}").collect() if number else []
        place_of = {r["bucket"]: r for r in before}
        batch.groupBy("tab_id").agg(*newest_load()).select("tab_id", "newest.*").write.mode("overwrite").parquet(f"{place}/batch")
        fresh = spark.read.schema(shape).parquet(f"{place}/batch").withColumn("bucket", bucket)
        touched = {r["bucket"]: r["newest_ts"] for r in fresh.groupBy("bucket").agg(F.max("ts").alias("newest_ts")).collect()}
        seen = [t for t in [*(r["newest_ts"] for r in before), *touched.values()] if t is not None]
        old = slots([place_of[b] for b in touched if b in place_of])
        state = old.select(*shape.names).unionByName(fresh.select(*shape.names)).groupBy("tab_id").agg(*newest_load()).select("tab_id", "newest.*")
        if late is not None and seen:
            state = state.filter(~F.col("closed") | (F.col("ts") > F.lit(max(seen)).cast(shape["ts"].dataType) - F.expr(f"INTERVAL {late}")))
        slot = {b: 1 - place_of[b]["slot"] if b in place_of else 0 for b in touched}
        if touched:
            turned = F.create_map(*[F.lit(x) for pair in slot.items() for x in pair])
            # a row that marks the bucket, so that a bucket without tabs replaces its slot, too
            marks = spark.createDataFrame([(b,) for b in touched], "bucket int")
            (state.withColumn("bucket", bucket).withColumn("filled", F.lit(True)).unionByName(marks.withColumn("filled", F.lit(False)), allowMissingColumns=True)
             .withColumn("slot", turned[F.col("bucket")]).repartition("bucket")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(rows))
        now = [(b, slot[b], number, max((t for t in (touched[b], place_of[b]["newest_ts"] if b in place_of else None) if t is not None), default=None)) for b in touched]
        now += [(r["bucket"], r["slot"], r["batch"], r["newest_ts"]) for b, r in place_of.items() if b not in touched]
        spark.createDataFrame(now, kept).coalesce(1).write.mode("overwrite").parquet(f"{index}/turn={number % 2}")

    run_batches(loads, handle, place)
    try:
        turns = spark.read.schema(f"{kept}, turn int").parquet(index)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return slots([]).filter("not closed").drop("closed", "filled")
    listed = turns.collect()
    newest = max((r["batch"] for r in listed), default=0)
    last = next((r["turn"] for r in listed if r["batch"] == newest), 0)
    return slots([r for r in listed if r["turn"] == last]).filter("not closed").drop("closed", "filled")


def dedup_stream(findings: DataFrame, keys: list[str], spread_by: list[str], delay: str, salts: int = 16) -> DataFrame:
    """One finding per key within the watermark, with state that ``delay`` bounds.

    Rows older than the watermark are dropped by Spark, first findings too, and a repeat later than ``delay`` shows
    again; where nothing may be lost use ``dedup_exactly``. Repeats of one key are first thinned out on several
    tasks, so a hot key does not meet whole.
    """
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts))
    return (findings.withWatermark("ts", delay).withColumn("_salt", spread)
            .dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt").dropDuplicatesWithinWatermark(keys))


def dedup_exactly(findings: DataFrame, keys: list[str], place: str | None = None, buckets: int = 256) -> DataFrame:
    """One finding per key for ever: no row is too late to be a first finding, no repeat too late to be dropped.

    Keys seen so far are a stored table with a folder per bucket of key hashes. A batch is reduced to one row per
    key (the smallest), reads only the buckets it has keys in, and adds its new keys under its own number, so a
    batch that runs again sees what it saw before. Null is a key value like any other. Keys must be atomic columns.
    """
    spark = findings.sparkSession
    place = place or scratch(spark, "unique")
    out, seen = f"{place}/rows", f"{place}/keys"
    rest = [c for c in findings.columns if c not in keys]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in findings.select(*keys).schema)}, bucket int, batch bigint"

    def handle(batch: DataFrame, number: int) -> None:
        least = F.min(F.struct(*rest)).alias("_rest") if rest else F.count("*").alias("_rest")
        firsts = batch.groupBy(*keys).agg(least).withColumn("bucket", bucket)
        touched = [r["bucket"] for r in firsts.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if number and touched:
            known = spark.read.schema(shape).parquet(seen).filter(F.col("bucket").isin(touched) & (F.col("batch") < number))
            same = F.lit(True)
            for key in ["bucket", *keys]:
                same = same & firsts[key].eqNullSafe(known[key])
            firsts = firsts.join(known, same, "left_anti")
        shown = firsts.select(*keys, *(["_rest.*"] if rest else []), "bucket")
        shown.drop("bucket").write.mode("overwrite").parquet(f"{out}/batch={number}")
        new = spark.read.schema(findings.schema).parquet(f"{out}/batch={number}").select(*keys, bucket.alias("bucket"), F.lit(number).cast("bigint").alias("batch"))
        # one batch replaces its own folders only
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(seen)

    run_batches(findings, handle, place)
    return spark.read.schema(findings.schema).parquet(out).select(*findings.columns)


def merge_by_tab(header_findings: DataFrame, dom_findings: DataFrame) -> DataFrame:
    """Findings of both kinds of one tab in one stream; no state is needed to put them together."""
    return header_findings.unionByName(dom_findings)


def memory_stream(findings: DataFrame, memory: DataFrame, salt_by: list[str], place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Mark known classes per batch, then merge the batch's confirmed classes into the memory.

    Returns the marked findings and the last memory version. Batch n reads version n and writes
    version n + 1. ``memory`` is version 0 of a new ``place``; a place that has progress keeps its own.
    """
    spark = findings.sparkSession
    place = place or scratch(spark, "memory")
    out, versions, shape = f"{place}/rows", f"{place}/versions", memory.schema

    def handle(batch: DataFrame, number: int) -> None:
        if number == 0:
            memory.write.mode("overwrite").parquet(f"{versions}/version=0")
        current = spark.read.schema(shape).parquet(f"{versions}/version={number}")
        marked = triage.mark_known(batch, current, salt_by)
        marked.write.mode("overwrite").parquet(f"{out}/batch={number}")
        confirmed = batch.filter("section = 'confirmed'")
        seen = confirmed.groupBy("class").agg(F.max("ts").alias("_seen"))
        merged = mem.merge_memory(current, seen, seen_at=None)
        merged.write.mode("overwrite").parquet(f"{versions}/version={number + 1}")

    run_batches(findings, handle, place)
    stored = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in shape)}, version bigint").parquet(versions)
    last = stored.agg(F.max("version")).first()[0] or 0
    return spark.read.parquet(out).drop("batch"), spark.read.schema(shape).parquet(f"{versions}/version={last}")
