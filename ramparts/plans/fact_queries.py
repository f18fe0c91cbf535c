"""Queries over given fact tables: resolution and taint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.operators import resolve, taint
from ramparts.plans.catalog import query
from ramparts.session import large, materialize
from ramparts.sources.derived import table

CALL_KEY = ["order_key", "seq"]


def functions(spark, sf) -> DataFrame:
    return table(spark, sf, "fx_function")


def params(spark, sf) -> DataFrame:
    each = functions(spark, sf).select("fn_id", F.posexplode(F.array("p0", "p1")).alias("pos", "name"))
    return each.filter("name is not null")


def imports(spark, sf) -> DataFrame:
    files = table(spark, sf, "fx_file")
    placed = table(spark, sf, "fx_import").join(large(files), "file_id")
    return resolve.resolve_modules(placed, files)


def calls(spark, sf) -> DataFrame:
    return table(spark, sf, "fx_call").withColumn("callee_kind", F.when(F.col("obj").isNull(), "id").otherwise("member"))


def resolved_calls(spark, sf) -> DataFrame:
    return resolve.resolve_calls(calls(spark, sf), imports(spark, sf), functions(spark, sf), table(spark, sf, "fx_export"), CALL_KEY)


def arguments(spark, sf) -> DataFrame:
    args = resolved_calls(spark, sf).filter("callee_fn is not null").select(
        *CALL_KEY, "fn_id", "callee_fn", F.lit(0).alias("pos"), F.col("arg0_ref").alias("ref"), F.col("arg0_has_source").alias("has_source"))
    return resolve.match_parameters(args, params(spark, sf), CALL_KEY)


def tainted_names(spark, sf, close=taint.closure) -> DataFrame:
    """Seeds and edges both read the resolved arguments, so those are written once."""
    bindings, args = table(spark, sf, "fx_binding"), materialize(arguments(spark, sf).filter("param is not null"), "arguments")
    return close(taint.source_seeds(bindings, args),
                 taint.binding_edges(bindings).unionByName(taint.argument_edges(args)))


@query
def join_module_resolution(spark, sf):
    return imports(spark, sf).select("file_id", "source", "target_file")


@query
def join_export_lookup(spark, sf):
    refs = imports(spark, sf).filter("target_file is not null")
    return resolve.resolve_exports(refs, table(spark, sf, "fx_export"), "target_file", "imported", ["file_id"]).select(
        "file_id", "target_file", "imported", "export_fn")


@query
def join_call_resolution(spark, sf):
    return resolved_calls(spark, sf).select(*CALL_KEY, "name", "obj", "callee_fn")


@query
def join_arg_param(spark, sf):
    return arguments(spark, sf).select(*CALL_KEY, "callee_fn", "ref", "param")


@query
def taint_local(spark, sf):
    bindings = table(spark, sf, "fx_binding")
    return taint.closure(taint.source_seeds(bindings), taint.binding_edges(bindings))


@query
def taint_interproc(spark, sf):
    named = lambda c: F.concat(F.lit("p"), F.col(c))
    edges = table(spark, sf, "fn_edge").select("src_fn", named("src_pos").alias("src_name"), "dst_fn", named("dst_pos").alias("dst_name"))
    seeds = table(spark, sf, "fn_seed").select(F.col("fn").alias("fn_id"), named("pos").alias("name"))
    return taint.closure(seeds, edges)


@query
def taint_carrier(spark, sf):
    return taint.carriers(table(spark, sf, "nest"))


def call_sites(spark, sf) -> DataFrame:
    """Calls with the flag whether argument 0 is tainted."""
    sites = calls(spark, sf).withColumn("refs", F.array_compact(F.array("arg0_ref")))
    return resolve.taint_flags(sites, tainted_names(spark, sf), "refs", CALL_KEY)


@query
def join_sink_taint(spark, sf):
    sinks = call_sites(spark, sf).filter("name in ('query', 'exec', 'readFile')")
    return sinks.select(*CALL_KEY, "name", "arg0_ref", (F.col("tainted") | F.col("arg0_has_source")).alias("confirmed"))


@query
def taint_reach(spark, sf):
    """Which sinks are reached from which sources: the nearest source of each sink's argument, and how far it is."""
    sinks = calls(spark, sf).filter("name in ('query', 'exec', 'readFile') and arg0_ref is not null").select(
        *CALL_KEY, "fn_id", F.col("arg0_ref").alias("ref"), "name", "line")
    sources = tainted_names(spark, sf, taint.traced_closure).select("fn_id", F.col("name").alias("ref"), "source_fn", "source_name", "hops")
    return sinks.join(large(sources), ["fn_id", "ref"]).select(*CALL_KEY, "fn_id", F.col("name").alias("sink"), F.col("line").cast("bigint").alias("line"),
                                                       "source_fn", "source_name", "hops")
