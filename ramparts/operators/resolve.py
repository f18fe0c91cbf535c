"""Name resolution over fact tables: modules, exports, calls, arguments.

Every lookup side is reduced to one row per key first, so ambiguous names drop out before any
join and no join can multiply rows. All joins go through ``lookup_join``: a helper that half of
all calls refer to is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.session import BROADCAST_ROWS, large, lookup_join


def normal_path(path: Column) -> Column:
    """Fold ``.`` and ``..``; steps above the root stay visible and therefore match no file."""
    def step(acc: Column, s: Column) -> Column:
        climbing = (F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1)) == "..")
        return (F.when(s.isin("", "."), acc)
                .when((s == "..") & ~F.coalesce(climbing, F.lit(True)), F.slice(acc, F.lit(1), F.size(acc) - 1))
                .otherwise(F.concat(acc, F.array(s))))
    return F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")


def module_keys(files: DataFrame, scope: list[str]) -> DataFrame:
    """(path without suffix) -> file, for every suffix an import may leave out; the earliest suffix wins.

    This turns nine candidate lookups per import into at most three keys per file.
    """
    options = []
    for place, suffix in enumerate(rules.MODULE_SUFFIXES):
        bare = suffix.lstrip("/")
        whole = (F.col("rel") == bare) if suffix.startswith("/") else F.lit(False)
        test = F.col("rel").endswith(suffix) | whole
        path = F.col("rel") if not suffix else F.when(whole, F.lit("")).otherwise(
            F.expr(f"left(rel, length(rel) - {len(suffix)})"))
        options.append(F.when(test, F.struct(F.lit(place).alias("place"), path.alias("path"))))
    keys = files.select(*scope, F.col("file_id").alias("target_file"), F.inline(F.array_compact(F.array(*options))))
    return keys.groupBy(*scope, "path").agg(F.min_by("target_file", "place").alias("target_file"))


def resolve_modules(imports: DataFrame, files: DataFrame, scope: list[str] | None = None,
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``target_file`` to imports; package imports and missing files stay null.

    ``imports`` carries the importing file's ``rel``.
    """
    scope = scope or []
    folder = F.regexp_extract(F.col("rel"), r"^(?:(.*)/)?[^/]*$", 1)
    path = F.when(F.col("source").startswith("."), normal_path(F.concat_ws("/", F.nullif(folder, F.lit("")), F.col("source"))))
    return lookup_join(imports.withColumn("path", path), module_keys(files, scope), [*scope, "path"],
                       ["file_id", "local"], broadcast_rows=broadcast_rows).drop("path")


def resolve_exports(refs: DataFrame, exports: DataFrame, module: str, name: str, salt_by: list[str],
                    broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``export_fn``: the named export of the module, else its default export."""
    unique = exports.groupBy("file_id", "export_name").agg(F.max("fn_id").alias("fn_id"))
    named = unique.select(F.col("file_id").alias(module), F.col("export_name").alias(name), F.col("fn_id").alias("_named"))
    default = unique.filter("export_name = 'default'").select(F.col("file_id").alias(module), F.col("fn_id").alias("_default"))
    out = lookup_join(refs, named, [module, name], salt_by, broadcast_rows=broadcast_rows)
    out = lookup_join(out, default, [module], salt_by, broadcast_rows=broadcast_rows)
    return out.withColumn("export_fn", F.coalesce("_named", "_default")).drop("_named", "_default")


def single_names(functions: DataFrame, scope: list[str], out: str) -> DataFrame:
    """Names that exactly one function has within ``scope``."""
    counted = functions.filter("name is not null").groupBy(*scope, "name").agg(
        F.count("*").alias("_n"), F.min("fn_id").alias(out))
    return counted.filter("_n = 1").drop("_n")


def resolve_calls(calls: DataFrame, imports: DataFrame, functions: DataFrame, exports: DataFrame, salt_by: list[str],
                  scope: list[str] | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``callee_fn``. An imported name is looked up in its module only; any other name means
    the single function of that name in the file, else in the whole program (``scope``), else none.

    ``calls`` has ``callee_kind`` ('id' or 'member'), ``obj`` and ``name``; ``imports`` has
    ``target_file``.
    """
    scope, rows = scope or [], broadcast_rows
    bound = imports.groupBy("file_id", F.col("local").alias("_key")).agg(
        F.max(F.struct("target_file", "imported")).alias("_import"))
    key = F.when(F.col("callee_kind") == "id", F.col("name")).otherwise(F.col("obj"))
    out = lookup_join(calls.withColumn("_key", key), bound, ["file_id", "_key"], salt_by, broadcast_rows=rows)
    imported = F.when(F.col("_import.imported") == "*", F.lit("default")).otherwise(F.col("_import.imported"))
    out = (out.withColumn("_module", F.col("_import.target_file"))
           .withColumn("_export", F.when(F.col("callee_kind") == "id", imported).otherwise(F.col("name"))))
    out = resolve_exports(out, exports, "_module", "_export", salt_by, rows)
    out = lookup_join(out, single_names(functions, ["file_id"], "_local"), ["file_id", "name"], salt_by, broadcast_rows=rows)
    out = lookup_join(out, single_names(functions, scope, "_global"), [*scope, "name"], salt_by, broadcast_rows=rows)
    found = F.when(F.col("_import").isNotNull(), F.col("export_fn")).otherwise(F.coalesce("_local", "_global"))
    return out.withColumn("callee_fn", found).drop("_key", "_import", "_module", "_export", "export_fn", "_local", "_global")


def match_parameters(args: DataFrame, params: DataFrame, salt_by: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Positional argument to parameter ``param``; null for patterns and surplus arguments."""
    named = params.select(F.col("fn_id").alias("callee_fn"), "pos", F.col("name").alias("param"))
    return lookup_join(args, named, ["callee_fn", "pos"], salt_by, broadcast_rows=broadcast_rows)


def taint_flags(sites: DataFrame, taint: DataFrame, refs: str, salt_by: list[str], out: str = "tainted",
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``out``: whether any name in ``refs`` is tainted in the site's function.

    ``salt_by`` identifies a site; the flag follows from its function and names alone, so repeated
    ids do no harm. Only sites that refer to names at all take part in the first join.
    """
    keys = [*dict.fromkeys([*salt_by, "fn_id", refs])]
    names = sites.select(*keys, F.explode(F.array_distinct(F.col(refs))).alias("name"))
    known = taint.select("fn_id", "name").distinct()
    hit = lookup_join(names, known.withColumn("_t", F.lit(True)), ["fn_id", "name"], salt_by, "inner", broadcast_rows)
    marked = hit.select(*keys).distinct().withColumn(out, F.lit(True))
    return sites.join(large(marked), keys, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))
