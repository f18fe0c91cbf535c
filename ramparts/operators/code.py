"""Code detectors over fact rows.

Call rules read one table of call sites: obj, name, args (text, kind, literal, callee, refs,
has_source, entries), the taint flags, and the place. All of them share one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.functions.text import per_application
from ramparts.operators import facts
from ramparts.operators.resolve import taint_flags
from ramparts.schemas import emit, finding, findings
from ramparts.session import BROADCAST_ROWS, large, lookup_join, materialize

# words of which a file must hold one from each list for a detector to find anything in it (``facts.mentioning``)
RANDOM_WORDS = [["Math"], ["random"]]
COMPARISON_WORDS = [["==", "!="]]
WEAK_HASH_WORDS = [["createHash"]]
RACE_WORDS = [["async", "await"], rules.READ_CALLS, rules.WRITE_CALLS]
OBJECT_WORDS = [rules.OBJECT_SINKS, rules.HANDLER_PARAMETERS]

SITE_RULES: dict[str, Callable[[], Column]] = {}


def site_rule(build: Callable[[], Column]) -> Callable[..., DataFrame]:
    """Register a rule over one call site and turn it into a detector of its own."""
    build = per_application(build)
    SITE_RULES[build.__name__] = build

    def detector(sites: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return emit(sites, [build()], keep)
    detector.__name__, detector.__doc__ = build.__name__, build.__doc__
    return detector


def scan_sites(sites: DataFrame, keep: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    return emit(sites, [SITE_RULES[name]() for name in (only or SITE_RULES)], keep)


def code_finding(detector_id: str, cls: str, severity: str, summary, evidence, **more) -> Column:
    return finding(detector_id=detector_id, cls=cls, severity=severity, unit=F.col("unit"), rel=F.col("rel"), line=F.col("line"),
                   col=F.col("col"), summary=summary, evidence=evidence, before=more.pop("before", F.col("source_line")), **more)


def _place() -> Column:
    return F.concat(F.col("rel"), F.lit(":"), F.col("line"))


def argument(pos: int) -> Column:
    return F.get("args", F.lit(pos))


def _tainted(pos: int = 0) -> Column:
    return F.coalesce(F.col("tainted") | argument(pos)["has_source"], F.lit(False))


@site_rule
def sql_injection() -> Column:
    hit = F.col("name").isin(rules.SQL_SINKS) & argument(0)["kind"].isin("plus", "template")
    return F.array(F.when(hit, code_finding(
        "sqli", "SQL Injection", "Critical", F.concat(F.lit("built text given to "), F.col("name")), F.concat(_place(), F.lit(" builds a query")),
        signal=_tainted(), impact="Input can change the meaning of the query.", after="use bound parameters", contract="same rows for honest input")))


@site_rule
def command_injection() -> Column:
    hit = F.col("name").isin(rules.SHELL_SINKS) & argument(0)["kind"].isin("plus", "template", "identifier", "member")
    return F.array(F.when(hit, code_finding(
        "commandInjection", "Command Injection", "Critical", F.concat(F.lit("dynamic command given to "), F.col("name")),
        F.concat(_place(), F.lit(" runs a built command")), signal=_tainted(), impact="Input can run commands of its own.",
        after="use execFile with an argument list", contract="same program, same arguments")))


@site_rule
def path_traversal() -> Column:
    first = argument(0)
    sink = (F.col("name").isin(rules.FILE_SINKS)
            | (F.col("name").isin(rules.SEND_FILE_SINKS) & F.coalesce(F.col("obj").isin(rules.RESPONSE_NAMES), F.lit(False))))
    built = first["kind"].isin("plus", "template") | ((first["kind"] == "call") & first["callee"].isin(rules.PATH_BUILDERS))
    hit = sink & (first["kind"] != "string") & (_tainted() | F.coalesce(built, F.lit(False)))
    return F.array(F.when(hit, code_finding(
        "pathTraversal", "Path Traversal", "High", F.concat(F.lit("dynamic path given to "), F.col("name")), F.concat(_place(), F.lit(" opens a built path")),
        signal=_tainted(), impact="Input can leave the intended folder.", after="resolve below a fixed folder and check the prefix",
        contract="same file for honest names")))


def _option(pos: int, name: str) -> Column:
    return F.get(F.filter(argument(pos)["entries"], lambda e: e["key"] == name), F.lit(0))["value"]


def _names_none(value: Column) -> Column:
    return F.coalesce(value.rlike(r"(?i)^(?:\[.*)?[\"']none[\"'](?:.*\])?$"), F.lit(False))


def _token_call(name: str) -> Column:
    return (F.col("name") == name) & F.coalesce(F.col("obj").rlike(rules.TOKEN_LIBRARIES), F.lit(False))


def _token_finding(severity: str, summary: str, after: str) -> Column:
    return code_finding("jwt", "JWT Implementation Error", severity, summary, F.concat(_place(), F.lit(" "), F.lit(summary)), signal=False,
                        impact="Tokens can be forged or never die.", after=after, contract="honest tokens keep working")


def _verify_allows_none() -> Column:
    return _names_none(_option(2, "algorithms")) | _names_none(_option(2, "algorithm"))


@site_rule
def token_none_algorithm() -> Column:
    bad = (_token_call("verify") & _verify_allows_none()) | (_token_call("sign") & _names_none(_option(2, "algorithm")))
    return F.array(F.when(bad, _token_finding("Critical", "the none algorithm is allowed", "pin a real algorithm")))


@site_rule
def token_no_algorithms() -> Column:
    bad = _token_call("verify") & ~_verify_allows_none() & _option(2, "algorithms").isNull()
    return F.array(F.when(bad, _token_finding("High", "verify pins no algorithm", "pass an algorithms list")))


@site_rule
def token_no_expiry() -> Column:
    bad = _token_call("sign") & _option(2, "expiresIn").isNull() & _option(0, "exp").isNull()
    return F.array(F.when(bad, _token_finding("Medium", "signed token never expires", "pass expiresIn")))


@site_rule
def token_decode() -> Column:
    return F.array(F.when(_token_call("decode"), _token_finding("High", "decode skips the signature", "use verify")))


@site_rule
def token_literal_secret() -> Column:
    bad = (_token_call("verify") | _token_call("sign")) & F.coalesce(argument(1)["kind"] == "string", F.lit(False))
    return F.array(F.when(bad, _token_finding("High", "token secret is a literal", "read the secret from the environment")))


@site_rule
def weak_hash() -> Column:
    algorithm = F.lower(argument(0)["literal"])
    hit = (F.col("name") == "createHash") & algorithm.isin(rules.WEAK_HASHES)
    return F.array(F.when(hit, code_finding(
        "weakCrypto", "Weak Hash Algorithm", "High", F.concat(F.upper(algorithm), F.lit(" used as a hash")), F.concat(_place(), F.lit(" hashes with "), algorithm),
        kind="runnable", check="weak-hash", value=algorithm, impact="Hashes can be reversed quickly.", after=slow_hash_advice(F.col("source_line")), contract="same decision")))


@site_rule
def insecure_cipher() -> Column:
    algorithm = F.lower(F.coalesce(argument(0)["literal"], F.lit("")))
    hit = (F.col("name") == "createCipher") | ((F.col("name") == "createCipheriv") & algorithm.contains("ecb"))
    shown = F.when(F.col("name") == "createCipher", "deprecated constructor").otherwise(algorithm)
    return F.array(F.when(hit, code_finding(
        "weakCrypto", "Insecure Cipher Mode", "High", F.concat(F.lit("insecure cipher: "), shown), F.concat(_place(), F.lit(" "), shown),
        kind="runnable", check="ecb", value=shown, impact="Equal blocks stay visible.", after="use aes-256-gcm with a random IV", contract="same plain text")))


def insecure_random(bindings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Math.random() below an assignment to a security-named variable."""
    bad = F.col("draws_random") & F.col("lhs").rlike(rules.RANDOM_TARGET)
    return emit(bindings, [F.array(F.when(bad, code_finding(
        "weakCrypto", "Insecure Randomness", "High", F.concat(F.lit("Math.random() feeds "), F.col("lhs")), F.concat(_place(), F.lit(" assigns Math.random() to "), F.col("lhs")),
        after=safe_random(F.col("source_line")), applyable=True, impact="The value can be predicted.", contract="same use, random value")))], keep)


def timing_compare(comparisons: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """An equality operator with a secret-named side and no literal side."""
    named = F.col("left_name").rlike(rules.COMPARED_SECRET) | F.col("right_name").rlike(rules.COMPARED_SECRET)
    bad = named & ~F.col("left_kind").isin("string", "number") & ~F.col("right_kind").isin("string", "number")
    return emit(comparisons, [F.array(F.when(bad, code_finding(
        "timingSafe", "Non-constant-time Comparison", "Medium", F.concat(F.col("left_name"), F.lit(" "), F.col("op"), F.lit(" "), F.col("right_name")),
        F.concat(_place(), F.lit(" compares a secret with "), F.col("op")), signal=False, after=constant_time(F.col("source_line")), applyable=True,
        impact="Timing tells how much of the secret matched.", contract="same truth value for equal lengths")))], keep)


def safe_random(line: Column) -> Column:
    return F.regexp_replace(line, r"Math\.random\(\)[\s\S]*", "crypto.randomBytes(32).toString('hex');")


def slow_hash_advice(line: Column) -> Column:
    return F.regexp_replace(line, r"(?i)createHash\(([\"'`])(?:md5|sha1)\1\)[\s\S]*", "// hash passwords with bcrypt, scrypt or argon2")


def constant_time(line: Column) -> Column:
    """The first comparison becomes a constant-time call; the ! of an unequal operator is kept."""
    operand = r"([0-9A-Za-z_.\[\]]+)"
    return F.regexp_replace(line, rf"^([\s\S]*?){operand}\s*(?:(!)==?|===?)\s*{operand}([\s\S]*)$",
                            "$1$3crypto.timingSafeEqual(Buffer.from(\\$2), Buffer.from(\\$4))$5".replace("\\$", "$"))


# ---- rules that look at whole functions ---------------------------------------------------------------


def without_comments(src: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(src, r"/\*[\s\S]*?\*/", " "), r"//[^\n]*", " ")


def is_unguarded_async(src: Column, is_async: Column) -> Column:
    """Async or awaiting, and no transaction, lock or upsert word outside comments."""
    return (is_async | src.rlike(r"(?<![0-9A-Za-z_$])await(?![0-9A-Za-z_$])")) & ~without_comments(src).rlike(rules.CONCURRENCY_GUARD)


def mentions_owner(src: Column) -> Column:
    root = "|".join(rules.HANDLER_PARAMETERS)
    props = "|".join(rules.OWNER_PROPERTIES)
    return src.rlike(rf"(?i)(?<![0-9a-z_$.])(?:{root})\s*\??\.\s*(?:{props})(?![0-9a-z_$])|(?<![0-9a-z_$])(?:{rules.OWNER_NAMES})(?![0-9a-z_$])")


def is_handler(params: Column) -> Column:
    return F.exists(params, lambda p: F.coalesce(p["name"].rlike(rf"(?i)^(?:{'|'.join(rules.HANDLER_PARAMETERS)})\z"), F.lit(False)))


def function_rows(lexed: facts.Lexed, keep: list[str], stored: bool = True) -> DataFrame:
    """One row per function with its text and the place of its first and last token."""
    return facts.functions_of(lexed, keep, with_parent=False, stored=stored).select("file_id", *keep, "fn_id", F.col("name").alias("fn_name"), "is_async", "params", "src", "start", "end")


def calls_within(functions: DataFrame, lexed: facts.Lexed, names: list[str], keep: list[str]) -> DataFrame:
    """Calls of one of ``names`` with every function around them, nested ones included."""
    functions = materialize(functions.select("file_id", *keep, "fn_id", "start", "end"), "within")
    calls = facts.calls_of(lexed, []).filter(F.col("name").isin(names)).select("file_id", "call_id", "p", "name", "line", "col", "args", "source_line")
    return functions.join(large(calls), "file_id").filter("p > start AND p <= `end`")


def check_then_act(functions: DataFrame, lexed: facts.Lexed, keep: list[str]) -> DataFrame:
    """First read and the first write at its line or later, per function that is async and unguarded."""
    open_fns = functions.filter(is_unguarded_async(F.col("src"), F.col("is_async")))
    calls = calls_within(open_fns, lexed, [*rules.READ_CALLS, *rules.WRITE_CALLS], keep)
    place = F.struct("line", "col", "name", "source_line")
    per_fn = calls.groupBy("file_id", "fn_id", *keep).agg(F.min(F.when(F.col("name").isin(rules.READ_CALLS), place)).alias("read"),
                                                          F.collect_list(F.when(F.col("name").isin(rules.WRITE_CALLS), place)).alias("writes"))
    later = F.array_min(F.filter("writes", lambda w: w["line"] >= F.col("read.line")))
    return per_fn.withColumn("write", later).filter("read IS NOT NULL AND write IS NOT NULL").select(
        *keep, "file_id", "fn_id", F.col("read.name").alias("read_name"), F.col("read.line").alias("line"), F.col("read.col").alias("col"),
        F.col("write.name").alias("write_name"), F.col("write.line").alias("write_line"), F.col("read.source_line").alias("source_line"))


def race_conditions(lexed: facts.Lexed, keep: list[str]) -> DataFrame:
    """Check-then-act findings; a nested function that repeats its parent's finding is dropped."""
    pairs = check_then_act(function_rows(lexed, keep), lexed, keep)
    rest = [c for c in pairs.columns if c not in ("file_id", "line")]
    once = pairs.groupBy("file_id", "line").agg(F.min_by(F.struct(*rest), "fn_id").alias("_p")).select("file_id", "line", "_p.*")
    return emit(once, [F.array(code_finding(
        "raceCondition", "Race Condition (TOCTOU)", "High", F.concat(F.col("read_name"), F.lit(" then "), F.col("write_name")),
        F.concat(_place(), F.lit(" reads, line "), F.col("write_line"), F.lit(" writes")), signal=False, impact="Two requests can both pass the check.",
        after="use a transaction or one conditional update", contract="same result for one request"))])


def check_then_act_facts(calls: DataFrame, functions: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The same pairing over fact tables: fn_id, read and write line and name.

    Reads shrink to one per function and writes to one per function and line before they meet, so
    the join never sees the calls of a hot function.
    """
    place = F.struct("line", "name").alias("at")
    reads = calls.filter(F.col("name").isin(rules.READ_CALLS)).select("fn_id", place).groupBy("fn_id").agg(F.min("at").alias("read"))
    guarded = functions.filter("is_async").select("fn_id").distinct()
    reads = lookup_join(reads, guarded, ["fn_id"], ["fn_id"], "inner", broadcast_rows)
    writes = calls.filter(F.col("name").isin(rules.WRITE_CALLS)).select("fn_id", "line", "name").groupBy("fn_id", "line").agg(F.min("name").alias("name"))
    pairs = writes.join(large(reads), "fn_id").filter("line >= read.line")
    acted = pairs.groupBy("fn_id", "read").agg(F.min(F.struct("line", "name")).alias("write"))
    return acted.select("fn_id", F.col("read.line").alias("read_line"), F.col("read.name").alias("read_name"),
                        F.col("write.line").alias("write_line"), F.col("write.name").alias("write_name"))


def owner_less_handlers(functions: DataFrame) -> DataFrame:
    return functions.filter(is_handler(F.col("params"))).filter(~mentions_owner(F.col("src")))


def object_authorization(lexed: facts.Lexed, taint: DataFrame, keep: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Object lookups by tainted arguments in handlers that never mention an owner."""
    sinks = calls_within(owner_less_handlers(function_rows(lexed, keep)), lexed, rules.OBJECT_SINKS, keep).select(
        "file_id", *keep, "fn_id", "call_id", "line", "col", "name", F.flatten(F.transform("args", lambda a: a["refs"])).alias("refs"),
        F.exists("args", lambda a: a["has_source"]).alias("has_source"), "source_line")
    flagged = taint_flags(sinks, taint, "refs", ["call_id"], broadcast_rows=broadcast_rows).filter("tainted or has_source")
    once = flagged.dropDuplicates(["call_id"])
    return emit(once, [F.array(code_finding(
        "authz", "Broken Object-Level Authorization", "High", F.concat(F.col("name"), F.lit(" by a client id, owner unchecked")),
        F.concat(_place(), F.lit(" "), F.col("name")), signal=False, impact="Any user can reach any object.", after="add the owner to the lookup",
        contract="same object for its owner"))])


def good_practices(files: DataFrame, code: str = "code") -> DataFrame:
    """(label, rel) for every good practice a file shows."""
    labels = F.array_compact(F.array(*[F.when(F.col(code).rlike(p), F.lit(label)) for label, p in rules.GOOD_PRACTICES]))
    return files.select(F.explode(labels).alias("label"), "rel", "file_id")


def first_per_label(practices: DataFrame) -> DataFrame:
    """The first file, in path order, per label; every task sends one row per label at most."""
    return practices.groupBy("label").agg(F.min("rel").alias("rel"))
