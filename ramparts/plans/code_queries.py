"""Queries over code text and over call-site facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.operators import code, facts, fixes, surface
from ramparts.plans import code_scan, fact_queries
from ramparts.plans.catalog import long, query
from ramparts.plans.surface_queries import web
from ramparts.session import large
from ramparts.sources.code_files import classify_unit, code_files
from ramparts.sources.derived import table

_PLACE = ["rel", "class", "severity", "section", "line", "summary"]


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where the input is fewer splits than cores, as with the small given files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sources(spark, sf, name: str) -> DataFrame:
    """A derived code table; its rows are spread before the text is built or looked at."""
    return spread(table(spark, sf, name))


def files(spark, sf) -> DataFrame:
    return code_files(sources(spark, sf, "code"))


def lexed(spark, sf, words=()) -> facts.Lexed:
    """The token table of the code files, or of those that hold the words a detector needs."""
    return facts.lex(facts.mentioning(files(spark, sf), *words), ["unit"])


# ---- lexical facts ---------------------------------------------------------------------------------


@query
def lex_functions(spark, sf):
    fns = facts.functions_of(facts.lex(sources(spark, sf, "mod"), [], ["functions"]), [], with_parent=False, stored=False)
    return fns.select("file_id", "name", "kind", "is_async", long("start_line"), long("end_line"), long("col"))


@query
def lex_calls(spark, sf):
    calls = facts.calls_of(facts.lex(sources(spark, sf, "mod"), [], ["calls"]), [], with_line=False)
    first = F.get("args", F.lit(0))
    return calls.select("file_id", "callee_kind", "obj", "name", long("line"), long("col"), F.size("args").cast("bigint").alias("n_args"),
                        first["kind"].alias("arg0_kind"), F.array_join(first["refs"], ",").alias("arg0_refs"), F.col("fn_id").isNotNull().alias("in_function"))


@query
def lex_bindings(spark, sf):
    binds = facts.bindings_of(facts.lex(sources(spark, sf, "mod"), [], ["bindings"]), with_line=False)
    return binds.select("file_id", long("line"), "lhs", F.array_join("refs", ",").alias("refs"), "has_source")


@query
def lex_imports(spark, sf):
    return facts.imports_of(facts.lex(sources(spark, sf, "mod"), [], ["imports"]), []).select("file_id", "local", "source", "imported")


@query
def lex_exports(spark, sf):
    lexed_mod = facts.lex(sources(spark, sf, "mod"), [], ["exports"])
    fns = facts.functions_of(lexed_mod, [], with_parent=False).select("fn_id", "name")
    return facts.exports_of(lexed_mod).join(large(fns), "fn_id").select("file_id", "export_name", F.col("name").alias("fn_name"))


@query
def src_request_member(spark, sf):
    asking = facts.mentioning(sources(spark, sf, "code"), rules.REQUEST_ROOTS, rules.REQUEST_PROPERTIES)
    found = facts.chains(facts.lex(asking, [])).filter("is_member")
    return found.select("file_id", F.col("text").alias("member"))


@query
def src_request_call(spark, sf):
    asking = facts.mentioning(sources(spark, sf, "fw"), rules.REQUEST_ROOTS, [*rules.REQUEST_BODY_CALLS, *rules.REQUEST_GETTERS])
    found = facts.chains(facts.lex(asking, [])).filter("is_request_call")
    return found.select("file_id", F.col("upto_call").alias("call"))


def _framework(spark, sf, reason: str, *words) -> DataFrame:
    seeds = code_scan.framework_seeds(facts.lex(facts.mentioning(sources(spark, sf, "fw"), *words), []))
    return seeds.filter(F.col("reason") == reason).select(F.split_part("fn_id", F.lit(":"), F.lit(1)).cast("bigint").alias("file_id"),
                                                          F.split_part("fn_id", F.lit(":"), F.lit(2)).cast("bigint").alias("line"), "name")


@query
def src_decorated_params(spark, sf):
    return _framework(spark, sf, "decorator", ["@"], rules.INPUT_DECORATORS)


@query
def src_graphql_args(spark, sf):
    return _framework(spark, sf, "graphql", rules.GRAPHQL_MAPS)


@query
def src_trpc_input(spark, sf):
    return _framework(spark, sf, "procedure", rules.PROCEDURE_CALLS, ["procedure", "input"], rules.PROCEDURE_INPUTS)


@query
def taint_code(spark, sf):
    """Imports, calls, bindings and taint, all from text: which names of which function are tainted."""
    lexed_mod = code_scan.lexed_files(sources(spark, sf, "mod").withColumn("unit", F.lit("business")), code_scan.TAINT_FACTS)
    fns = facts.functions_of(lexed_mod, [], with_parent=False).select("fn_id", "file_id", F.col("name").alias("fn_name"))
    return code_scan.taint_of(lexed_mod).join(large(fns), "fn_id").select("file_id", "fn_name", "name")


@query
def scan_framework_code(spark, sf):
    """The whole code scan over framework styles: sources, taint, sinks, sections."""
    found = code_scan.scan_code(sources(spark, sf, "fw").withColumn("unit", classify_unit(F.col("rel"))))
    return found.select(*_PLACE, "unit").withColumn("line", long("line"))


@query
def scan_code_report(spark, sf):
    """The whole code scan over all kinds of faults."""
    return code_scan.scan_code(files(spark, sf)).select(*_PLACE, "unit").withColumn("line", long("line"))


# ---- detectors over call-site facts ------------------------------------------------------------------


def sites(spark, sf, with_taint: bool = False) -> DataFrame:
    base = fact_queries.call_sites(spark, sf) if with_taint else fact_queries.calls(spark, sf).withColumn("tainted", F.lit(False))
    renamed = base.withColumn("name", F.expr(
        "CASE WHEN name = 'sign' AND order_key % 7 = 0 THEN 'decode' WHEN name = 'createCipheriv' AND order_key % 9 = 0 THEN 'createCipher' ELSE name END"))
    args = F.expr("""array(
      named_struct('kind', arg0_kind, 'literal', arg0_literal, 'callee', CASE WHEN arg0_kind = 'call' AND order_key % 2 = 0 THEN 'join' END,
        'refs', array_compact(array(arg0_ref)), 'has_source', arg0_has_source, 'entries', CAST(NULL AS ARRAY<STRUCT<key: STRING, value: STRING>>)),
      named_struct('kind', CASE WHEN order_key % 5 = 0 THEN 'string' ELSE 'identifier' END, 'literal', CAST(NULL AS STRING), 'callee', CAST(NULL AS STRING),
        'refs', CAST(array() AS ARRAY<STRING>), 'has_source', false, 'entries', CAST(NULL AS ARRAY<STRUCT<key: STRING, value: STRING>>)),
      named_struct('kind', 'object', 'literal', CAST(NULL AS STRING), 'callee', CAST(NULL AS STRING), 'refs', CAST(array() AS ARRAY<STRING>), 'has_source', false,
        'entries', CASE option_key WHEN 'algorithms' THEN array(named_struct('key', 'algorithms', 'value', '["RS256"]'))
          WHEN 'expiresIn' THEN array(named_struct('key', 'expiresIn', 'value', '"1h"'))
          WHEN 'none' THEN array(named_struct('key', 'algorithms', 'value', '["none"]'), named_struct('key', 'algorithm', 'value', '"none"')) END))""")
    return renamed.withColumn("args", args).withColumn("unit", F.lit("business")).withColumn("col", F.lit(1)).withColumn(
        "rel", F.concat(F.lit("file/"), F.col("file_id"))).withColumn("source_line", F.lit(None).cast("string"))


def _register(name: str, rule: str, with_taint: bool = False):
    def run(spark, sf):
        return code.scan_sites(sites(spark, sf, with_taint), only=[rule]).select(*_PLACE).withColumn("line", long("line"))
    run.__name__ = name
    query(run)


for _name, _rule, _taint in [
    ("det_sqli", "sql_injection", True), ("det_command_injection", "command_injection", True), ("det_path_traversal", "path_traversal", True),
    ("det_jwt_none_alg", "token_none_algorithm", False), ("det_jwt_no_algorithms", "token_no_algorithms", False),
    ("det_jwt_no_expiry", "token_no_expiry", False), ("det_jwt_decode", "token_decode", False),
    ("det_jwt_literal_secret", "token_literal_secret", False), ("det_weak_hash", "weak_hash", False), ("det_insecure_cipher", "insecure_cipher", False),
]:
    _register(_name, _rule, _taint)


@query
def join_check_then_act(spark, sf):
    pairs = code.check_then_act_facts(fact_queries.calls(spark, sf), fact_queries.functions(spark, sf))
    return pairs.select("fn_id", long("read_line"), "read_name", long("write_line"), "write_name")


# ---- detectors over text -------------------------------------------------------------------------------


@query
def det_insecure_random(spark, sf):
    found = code.insecure_random(facts.bindings_of(lexed(spark, sf, code.RANDOM_WORDS), ["rel", "unit"]))
    return found.select(*_PLACE, "col").withColumn("line", long("line")).withColumn("col", long("col"))


@query
def det_timing_compare(spark, sf):
    found = code.timing_compare(facts.comparisons_of(lexed(spark, sf, code.COMPARISON_WORDS), ["rel", "unit"]))
    return found.select(*_PLACE, "col").withColumn("line", long("line")).withColumn("col", long("col"))


@query
def det_race_toctou(spark, sf):
    found = code.race_conditions(lexed(spark, sf, code.RACE_WORDS), ["rel", "unit"])
    return found.select(*_PLACE, "evidence").withColumn("line", long("line"))


@query
def det_object_authz(spark, sf):
    from ramparts.operators import taint
    text = lexed(spark, sf, code.OBJECT_WORDS)
    binds = facts.bindings_of(text, with_line=False).filter("fn_id is not null")
    tainted = taint.closure(taint.source_seeds(binds), taint.binding_edges(binds.select("fn_id", "lhs", F.explode("refs").alias("ref"))))
    return code.object_authorization(text, tainted, ["rel", "unit"]).select(*_PLACE).withColumn("line", long("line"))


@query
def antijoin_owner_check(spark, sf):
    rows = code.function_rows(lexed(spark, sf, [rules.HANDLER_PARAMETERS]), ["rel"], stored=False)
    return code.owner_less_handlers(rows).select("rel", F.col("fn_name").alias("name"))


@query
def antijoin_concurrency_guard(spark, sf):
    rows = code.function_rows(lexed(spark, sf, [["async", "await"]]), ["rel"], stored=False)
    return rows.filter(code.is_unguarded_async(F.col("src"), F.col("is_async"))).select("rel", F.col("fn_name").alias("name"))


@query
def pos_code(spark, sf):
    return code.good_practices(files(spark, sf)).select("label", "rel")


@query
def agg_positive_first(spark, sf):
    return code.first_per_label(code.good_practices(files(spark, sf)))


@query
def agg_scan_stats(spark, sf):
    return files(spark, sf).agg(F.count("*").alias("files"), F.count_distinct("unit").alias("units"))


@query
def agg_unit_counts(spark, sf):
    return files(spark, sf).groupBy("unit").agg(F.count("*").alias("files"))


def _suggested(spark, sf) -> DataFrame:
    """Rewrites of three detectors, each over the files that hold its words."""
    def text(words) -> facts.Lexed:
        return lexed(spark, sf, words)
    keep = ["rel", "unit"]
    calls = facts.calls_of(text(code.WEAK_HASH_WORDS), keep).withColumn("tainted", F.lit(False))
    parts = [code.insecure_random(facts.bindings_of(text(code.RANDOM_WORDS), keep), ["file_id"]),
             code.timing_compare(facts.comparisons_of(text(code.COMPARISON_WORDS), keep), ["file_id"]),
             code.scan_sites(calls, ["file_id"], only=["weak_hash"])]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return fixes.suggest_fixes(every, ["file_id", "rel"])


@query
def suggest_fixes(spark, sf):
    in_code = _suggested(spark, sf).select("rel", "class", long("line"), "before", "after", "applyable")
    mixed = fixes.suggest_fixes(surface.mixed_content(web(spark, sf)), ["rel"]).select("rel", "class", long("line"), "before", "after", "applyable")
    return in_code.unionByName(mixed)


@query
def apply_fixes(spark, sf):
    stale = _suggested(spark, sf).withColumn("before", F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("gone "), F.col("before"))).otherwise(F.col("before")))
    done = fixes.apply_fixes(files(spark, sf).select("file_id", "code"), stale)
    return done.select("file_id", "code", "applied", "conflicts")
