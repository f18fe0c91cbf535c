"""The whole code flow: files to facts to taint to findings."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ramparts.operators import code, facts, resolve, rule_rows, secrets, taint, triage
from ramparts.session import materialize

log = logging.getLogger(__name__)
CUSTOM_DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SHOWN = ["class", "severity", "section", "proven", "unit", "rel", "line", "col", "summary", "evidence", "detector_id", "known", "impact",
         "remediation", "proof"]


def register_detector(detector_id: str, detect: Callable[[DataFrame], DataFrame]) -> None:
    """Add a detector that turns code files into findings; it joins every later scan."""
    CUSTOM_DETECTORS[detector_id] = detect


def scope_of(files: DataFrame) -> list[str]:
    """Names and paths mean something within one repository only, if the files tell it."""
    return ["repo"] if "repo" in files.columns else []


# the facts that ``taint_of`` reads
TAINT_FACTS = ["calls", "bindings", "imports", "exports"]


def lexed_files(files: DataFrame, only: list[str] | None = None) -> facts.Lexed:
    """The token table of code files, written once since every detector reads it; ``only`` for some facts as in ``facts.lex``."""
    return facts.lex(files, ["unit", *scope_of(files)], only)


def argument_flow(lexed: facts.Lexed) -> DataFrame:
    """Call arguments with the parameter they reach: fn_id (the carrier), ref, has_source, callee_fn, param."""
    scope = scope_of(lexed.files)
    calls = facts.calls_of(lexed, scope, with_line=False).filter("carrier_fn is not null and size(args) > 0")
    # imports, exports and names are looked up several times and each is many joins over tokens: written once, they are not planned again every time
    imports = materialize(facts.imports_of(lexed, scope), "imports")
    targets = materialize(resolve.resolve_modules(imports, lexed.files.select("file_id", "rel", *scope), scope), "targets")
    named = materialize(facts.functions_of(lexed, scope, with_parent=False).select(*scope, "fn_id", "file_id", "name"), "names")
    exports = materialize(facts.exports_of(lexed), "exports")
    slim = calls.select(*scope, "call_id", "file_id", "carrier_fn", "callee_kind", "obj", "name",
                        F.transform("args", lambda a: F.struct(a["refs"].alias("refs"), a["has_source"].alias("has_source"))).alias("args"))
    resolved = resolve.resolve_calls(slim, targets, named, exports, ["call_id"], scope).filter("callee_fn is not null")
    each = resolved.select("call_id", F.col("carrier_fn").alias("fn_id"), "callee_fn", F.posexplode("args").alias("pos", "a")).select(
        "call_id", "fn_id", "callee_fn", "pos", "a.refs", "a.has_source")
    params = facts.params_of(lexed).filter("name is not null").select("fn_id", "pos", "name")
    return resolve.match_parameters(each, params, ["call_id"]).filter("param is not null")


def framework_seeds(lexed: facts.Lexed) -> DataFrame:
    """Decorated parameters, resolver arguments and procedure inputs as (fn_id, name, reason)."""
    def named(field: str, reason: str) -> Column:
        return F.transform(field, lambda n: F.struct(n.alias("name"), F.lit(reason).alias("reason")))
    handed = F.concat(named("decorated", "decorator"), named("resolver", "graphql"), named("procedure", "procedure"))
    return facts.functions_of(lexed, [], with_parent=False).select("fn_id", F.inline(handed))


def taint_of(lexed: facts.Lexed) -> DataFrame:
    """Local and interprocedural taint in one closure."""
    flow = materialize(argument_flow(lexed), "flow")
    binds = facts.bindings_of(lexed, with_line=False).filter("fn_id is not null")
    edges = taint.binding_edges(binds.select("fn_id", "lhs", F.explode("refs").alias("ref"))).unionByName(
        taint.argument_edges(flow.select("fn_id", "callee_fn", "param", F.explode("refs").alias("ref"))))
    seeds = taint.source_seeds(binds, flow).unionByName(framework_seeds(lexed).select("fn_id", "name"))
    return taint.closure(seeds, edges)


def call_sites(lexed: facts.Lexed, tainted: DataFrame, keep: list[str]) -> DataFrame:
    """Call sites with the flag whether argument 0 is tainted in the nearest function."""
    calls = facts.calls_of(lexed, keep)
    refs = F.coalesce(F.get("args", F.lit(0))["refs"], F.array().cast("array<string>"))
    return resolve.taint_flags(calls.withColumn("_refs", refs), tainted, "_refs", ["call_id"]).drop("_refs")


def custom_findings(files: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Findings of the registered detectors, and (detector_id, reason) of those that failed.

    Each one is run and written on its own, so a failing detector costs its own findings only. Whatever it
    raises, while it is planned or while it runs, is logged and becomes a row; nothing of it is kept.
    """
    found, failed = [], []
    for detector_id, detect in CUSTOM_DETECTORS.items():
        try:
            found.append(materialize(detect(files).select(*SHOWN), "custom"))
        except Exception as error:  # noqa: BLE001
            log.warning("detector %s failed and is left out: %s", detector_id, error)
            failed.append((detector_id, f"{type(error).__name__}: {error}"))
    return found, files.sparkSession.createDataFrame(failed, "detector_id string, reason string")


def scan_with_quarantine(files: DataFrame, memory: DataFrame | None = None, rules: list[Row] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of all detectors over code files (file_id, rel, code, unit), and the detectors that failed.

    ``rules`` are rows of a rule table as ``rule_rows.load_rules`` gives them; they add their findings.
    """
    lexed = lexed_files(files)
    tainted = taint_of(lexed)
    keep = ["rel", "unit"]
    place = F.col("rel")
    custom, failed = custom_findings(files)
    parts = [
        secrets.located_provider_findings(files, "code", place, ["file_id", "rel"]),
        secrets.assignment_findings(files, "code", place, ["file_id", "rel"], reported_by_provider=False),
        # written one after the other: as one plan their stages and scans, each a broadcast of its own, all start at once and fill the driver
        materialize(code.scan_sites(call_sites(lexed, tainted, keep)).select(*SHOWN), "sites"),
        code.insecure_random(facts.bindings_of(lexed, keep)),
        code.timing_compare(facts.comparisons_of(lexed, keep)),
        materialize(code.race_conditions(lexed, keep).select(*SHOWN), "races"),
        materialize(code.object_authorization(lexed, tainted, keep).select(*SHOWN), "objects"),
        *custom,
    ]
    if rules:
        parts.append(rule_rows.rule_findings(files, rules, "code", place, ["file_id", "rel"]))
    every = triage.union_findings([p.select(*SHOWN) for p in parts])
    if memory is not None:
        every = triage.mark_known(every, memory, ["rel", "line", "col", "detector_id"])
    return every, failed


def scan_code(files: DataFrame, memory: DataFrame | None = None, rules: list[Row] | None = None) -> DataFrame:
    """Findings of all detectors over code files; failing custom detectors are logged and left out."""
    return scan_with_quarantine(files, memory, rules)[0]
