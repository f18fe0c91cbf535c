"""Taint as reachability: one edge table, one loop, everything written to shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ramparts.session import BROADCAST_ROWS, hot_keys, large, lookup_join, materialize, salt_many, salt_one, scratch

_SRC = ["src_fn", "src_name"]


class FixpointError(RuntimeError):
    """The loop did not settle within the allowed rounds."""


def closure(seeds: DataFrame, edges: DataFrame, max_rounds: int = 100_000, broadcast_rows: int = BROADCAST_ROWS,
            salts: int = 32, shortcut_after: int = 8) -> DataFrame:
    """Every (fn_id, name) that ``seeds`` reach over ``edges`` (src_fn, src_name, dst_fn, dst_name).

    Semi-naive: a round joins only the newest names with the edges and keeps what was not known.
    The edges are de-duplicated, salted on hot source names and bucketed once, so no round
    shuffles them; a round whose new names are few broadcasts those instead. Each round is its own
    folder of one table, which cuts lineage and lets a lost executor be replaced at any time.

    If names are still found after ``shortcut_after`` rounds, what is left of the graph is made shorter first
    (``shortcut``) and the closure goes on over it, with twice as many rounds before the next shortening. A chain
    of n names takes log3(n) rounds that way, not n.
    """
    known, settled = _spread(seeds, edges, min(max_rounds, shortcut_after), broadcast_rows, salts, traced=False)
    if settled:
        return known
    if shortcut_after >= max_rounds:
        raise FixpointError(f"taint still grows after {max_rounds} rounds")
    places, begun, rest = shortcut(known, edges)
    inner = closure(begun, rest, max_rounds - shortcut_after, broadcast_rows, salts, 2 * shortcut_after)
    behind = places.filter("root_fn IS NOT NULL").join(
        large(inner.withColumnsRenamed({"fn_id": "root_fn", "name": "root_name"})), ["root_fn", "root_name"], "left_semi")
    return known.unionByName(places.filter("root_fn IS NULL").select("fn_id", "name")).unionByName(behind.select("fn_id", "name"))


def shortcut(known: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of ``edges`` once ``known`` names are reached, with names that only one other name leads to merged into it.

    A name with a single name before it is reached exactly if that one is, so it follows its pointer up to a name
    that is known or that several names lead to: its root. Every written round triples how far pointers reach. Names
    behind nothing, or behind a circle that nothing enters, have no root and are never reached.
    Gives ``places`` (fn_id, name, root_fn, root_name; a null root is reached already), the roots that a reached name
    leads to as new seeds, and the edges between roots.
    """
    before, there = (F.struct(F.col(f"{end}_fn").alias("fn_id"), F.col(f"{end}_name").alias("name")) for end in ("src", "dst"))
    sure = known.select(F.col("fn_id").alias("src_fn"), F.col("name").alias("src_name"), F.lit(True).alias("_sure"))
    left = materialize(
        _clean(edges).filter(before != there).join(large(known.withColumnsRenamed({"fn_id": "dst_fn", "name": "dst_name"})), ["dst_fn", "dst_name"], "left_anti")
        .join(large(sure), _SRC, "left").withColumn("_sure", F.coalesce("_sure", F.lit(False))), "shortcut-edges")
    ways = left.groupBy("dst_fn", "dst_name").agg(F.bool_or("_sure").alias("_reached"), F.min(before).alias("_least"), F.max(before).alias("_most"))
    several = F.col("_least") != F.col("_most")
    pointers = ways.select(
        F.col("dst_fn").alias("fn_id"), F.col("dst_name").alias("name"),
        F.when(~F.col("_reached"), F.when(several, there).otherwise(F.col("_least"))).alias("at"), (F.col("_reached") | several).alias("done"))
    open_rows, span = None, 1
    while True:
        counted, path = Observation(), scratch(left.sparkSession, "pointers")
        pointers.observe(counted, F.count_if(~F.col("done")).alias("rows")).write.parquet(path)
        pointers = left.sparkSession.read.schema(pointers.schema).parquet(path)
        now_open = counted.get["rows"]
        open_rows = now_open if open_rows is None else open_rows
        # as many steps as there were open pointers: what is open still goes in a circle
        if not now_open or span > open_rows:
            break
        ahead = pointers.select(F.struct("fn_id", "name").alias("at"), F.col("at").alias("_next"), F.col("done").alias("_done"))
        moving = pointers.filter("not done")
        for _ in range(2):
            # a pointer to a name that nothing leads to finds no row and ends here
            moving = (moving.join(large(ahead), "at").select("fn_id", "name", F.when(F.col("done"), F.col("at")).otherwise(F.col("_next")).alias("at"),
                                                      (F.col("done") | F.col("_done")).alias("done"))
                      .unionByName(moving.filter("at IS NULL")))
        pointers = pointers.filter("done").unionByName(moving)
        span *= 3
    places = pointers.filter("done").select("fn_id", "name", F.col("at.fn_id").alias("root_fn"), F.col("at.name").alias("root_name"))
    roots = places.filter("fn_id = root_fn AND name = root_name").select(F.col("fn_id").alias("dst_fn"), F.col("name").alias("dst_name"))
    moved = materialize(
        left.join(large(roots), ["dst_fn", "dst_name"], "left_semi").select(*_SRC, "dst_fn", "dst_name")
        .join(large(places.withColumnsRenamed({"fn_id": "src_fn", "name": "src_name"})), _SRC)
        .select(F.col("root_fn").alias("src_fn"), F.col("root_name").alias("src_name"), "dst_fn", "dst_name").distinct(), "shortcut-rest")
    begun = moved.filter("src_fn IS NULL").select(F.col("dst_fn").alias("fn_id"), F.col("dst_name").alias("name"))
    return places, begun, moved.filter("src_fn IS NOT NULL").filter(before != there)


def traced_closure(seeds: DataFrame, edges: DataFrame, max_rounds: int = 100_000, broadcast_rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """``closure`` with provenance: ``hops`` edges from the nearest seed, that seed, and the name before on the way.

    Of several nearest seeds the smallest (source_fn, source_name) is kept, and of several names before on a
    shortest way from it the smallest (via_fn, via_name); a seed is its own source and has none before it.
    """
    reached, settled = _spread(seeds, edges, max_rounds, broadcast_rows, salts, traced=True)
    if not settled:
        raise FixpointError(f"taint still grows after {max_rounds} rounds")
    return reached


_TRACE = ["source_fn", "source_name", "via_fn", "via_name"]


def _clean(edges: DataFrame) -> DataFrame:
    return (edges.filter("src_fn is not null and src_name is not null and dst_fn is not null and dst_name is not null")
            .select(*_SRC, "dst_fn", "dst_name").distinct())


def _spread(seeds: DataFrame, edges: DataFrame, max_rounds: int, broadcast_rows: int, salts: int, traced: bool) -> tuple[DataFrame, bool]:
    """The names reached in at most ``max_rounds`` rounds, and whether these are all."""
    spark = edges.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edge_path, taint_path = scratch(spark, "edges"), scratch(spark, "taint")
    edge_table = f"ramparts_edges_{uuid.uuid4().hex}"
    clean = materialize(_clean(edges), "edges-raw")
    hot = materialize(hot_keys(clean, _SRC), "edges-hot")
    keys = [*_SRC, "_salt"]
    (salt_many(clean, hot, _SRC, ["dst_fn", "dst_name"], salts).repartition(buckets, *keys)
     .write.bucketBy(buckets, *keys).option("path", edge_path).saveAsTable(edge_table))
    edge_rows = spark.table(edge_table)
    shown = ["fn_id", "name", *(["hops", *_TRACE] if traced else [])]
    try:
        fresh = seeds.select("fn_id", "name").filter("fn_id is not null and name is not null").distinct()
        if traced:
            kind = seeds.schema["fn_id"].dataType
            fresh = fresh.select("fn_id", "name", F.lit(0).cast("bigint").alias("hops"), F.col("fn_id").alias("source_fn"), F.col("name").alias("source_name"),
                                 F.lit(None).cast(kind).alias("via_fn"), F.lit(None).cast("string").alias("via_name"))
        shape, total = fresh.schema, 0
        for number in range(max_rounds):
            written = Observation()
            fresh.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(f"{taint_path}/round={number}")
            newest, size = spark.read.schema(shape).parquet(f"{taint_path}/round={number}"), written.get["rows"]
            total += size
            if size == 0:
                break
            step = newest.withColumnsRenamed({"fn_id": "src_fn", "name": "src_name"})
            if size <= broadcast_rows:
                reached = edge_rows.join(F.broadcast(step), _SRC)
            else:
                reached = edge_rows.join(large(salt_one(step, hot, _SRC, salts)), keys)
            known = spark.read.schema(shape).parquet(*[f"{taint_path}/round={n}" for n in range(number + 1)]).select("fn_id", "name")
            there = [F.col("dst_fn").alias("fn_id"), F.col("dst_name").alias("name")]
            if traced:
                way = F.struct("source_fn", "source_name", F.col("src_fn").alias("via_fn"), F.col("src_name").alias("via_name"))
                step = reached.groupBy(*there).agg(F.min(way).alias("_way")).select("fn_id", "name", F.lit(number + 1).cast("bigint").alias("hops"), "_way.*")
            else:
                step = reached.select(*there).distinct()
            fresh = _unknown(step, known, total, broadcast_rows)
        return spark.read.schema(shape).option("basePath", taint_path).parquet(taint_path).select(*shown), size == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {edge_table}")


def _unknown(step: DataFrame, known: DataFrame, known_rows: int, broadcast_rows: int) -> DataFrame:
    """The rows of ``step`` that are not ``known``. Known names are only shuffled where the step has many names, too."""
    place = ["fn_id", "name"]
    if known_rows <= broadcast_rows:
        return step.join(F.broadcast(known), place, "left_anti")
    counted, path = Observation(), scratch(step.sparkSession, "step")
    step.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    step = step.sparkSession.read.schema(step.schema).parquet(path)
    if counted.get["rows"] <= broadcast_rows:
        known = known.join(F.broadcast(step.select(*place)), place, "left_semi")
    return step.join(large(known), place, "left_anti")


def witness_paths(traced: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (fn_id, name) with ``path``: (fn_id, name) from their source to themselves, one shortest way.

    Walks back one edge a round for all targets together, and only targets that are not at their source yet take part.
    """
    place = F.struct("fn_id", "name")
    open_paths = targets.select("fn_id", "name").distinct().select("fn_id", "name", F.col("fn_id").alias("at_fn"), F.col("name").alias("at_name"), F.array(place).alias("path"))
    back = traced.select(F.col("fn_id").alias("at_fn"), F.col("name").alias("at_name"), "via_fn", "via_name")
    done = None
    while True:
        step = materialize(open_paths.join(large(back), ["at_fn", "at_name"]), "witness")
        ended = step.filter("via_fn IS NULL").select("fn_id", "name", "path")
        done = ended if done is None else done.unionByName(ended)
        rest = step.filter("via_fn IS NOT NULL")
        if rest.isEmpty():
            return done
        before = F.struct(F.col("via_fn").alias("fn_id"), F.col("via_name").alias("name"))
        open_paths = rest.select("fn_id", "name", F.col("via_fn").alias("at_fn"), F.col("via_name").alias("at_name"), F.concat(F.array(before), F.col("path")).alias("path"))


def binding_edges(bindings: DataFrame) -> DataFrame:
    """Within a function: a name flows into the variable whose expression refers to it."""
    return bindings.select(F.col("fn_id").alias("src_fn"), F.col("ref").alias("src_name"),
                           F.col("fn_id").alias("dst_fn"), F.col("lhs").alias("dst_name"))


def argument_edges(args: DataFrame) -> DataFrame:
    """Between functions: a name in an argument flows into the callee's parameter."""
    return args.select(F.col("fn_id").alias("src_fn"), F.col("ref").alias("src_name"),
                       F.col("callee_fn").alias("dst_fn"), F.col("param").alias("dst_name"))


def source_seeds(bindings: DataFrame, args: DataFrame | None = None) -> DataFrame:
    """Names bound to request data, and parameters that are handed request data."""
    seeds = bindings.filter("has_source").select("fn_id", F.col("lhs").alias("name"))
    if args is None:
        return seeds
    return seeds.unionByName(args.filter("has_source").select(F.col("callee_fn").alias("fn_id"), F.col("param").alias("name")))


def carriers(functions: DataFrame, max_rounds: int = 64, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(fn_id, carrier_fn): the nearest enclosing function, itself included, that carries taint.

    ``functions`` has fn_id, parent_fn and is_carrier. Pointers double in every round, so a
    nesting of depth d takes log2(d) rounds.
    """
    jumps = functions.select("fn_id", F.when(F.col("is_carrier"), F.col("fn_id")).otherwise(F.col("parent_fn")).alias("at"),
                             (F.col("is_carrier") | F.col("parent_fn").isNull()).alias("done"))
    for _ in range(max_rounds):
        jumps = materialize(jumps, "carriers")
        open_jumps = jumps.filter("not done")
        if open_jumps.isEmpty():
            return jumps.select("fn_id", F.col("at").alias("carrier_fn"))
        ahead = jumps.select(F.col("fn_id").alias("at"), F.col("at").alias("_next"), F.col("done").alias("_done"))
        moved = lookup_join(open_jumps.select("fn_id", "at"), ahead, ["at"], ["fn_id"], broadcast_rows=broadcast_rows)
        jumps = jumps.filter("done").unionByName(
            moved.select("fn_id", F.col("_next").alias("at"), F.coalesce("_done", F.lit(True)).alias("done")))
    raise FixpointError("functions are nested deeper than the allowed rounds can reach, or in a circle")
