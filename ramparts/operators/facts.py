"""Code facts from the token table: functions, calls, bindings, imports, exports and comparisons.

Every fact is a filter or a grouping of token rows (see ``tokens``): a call is an opening bracket behind a name, its
arguments are the parts of that bracket, a function reaches to the partner of its brace, names flow from where they
stand into every argument or binding around them that shares their region. Nothing looks at indentation, and no
length, nesting or count is bounded. Joins are on the file and a token's place, so rows stay spread by file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.operators import spans
from ramparts.operators import tokens as tok
from ramparts.session import is_small, large, materialize

NAME = r"[A-Za-z_$][0-9A-Za-z_$]*"
SOURCE = "__source__"
_NOT_CALLED = ["if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "async"]
_NOT_NAMES = ["await", "async", "true", "false", "null", "undefined", "typeof", "this", "new", "void", "delete", "function",
              "instanceof", "in", "of", "yield", "return", "const", "let", "var", "if", "else", "for", "while", "switch", "case"]
_MODIFIERS = "public|private|protected|readonly|override"
_DOTS = [".", "?."]


@dataclass(frozen=True)
class Lexed:
    """Files (file_id, rel, kept columns, code), their token table, and the facts that were read from it so far."""

    files: DataFrame
    stored: DataFrame | None
    keep: tuple[str, ...]
    made: dict[str, DataFrame] = field(default_factory=dict)
    # the columns of the token table and the tokens that will be read, all without it
    needs: tuple[list[str], str] | None = None

    @property
    def tokens(self) -> DataFrame:
        """The token table, written when the first fact asks for it."""
        if self.stored is not None:
            return self.stored
        if "tokens" not in self.made:
            self.made["tokens"] = tok.stored_tokens(self.files.select("file_id", "code"), *(self.needs or ()))
        return self.made["tokens"]

    @property
    def repeated(self) -> DataFrame | None:
        """Ids that several files share, None if there are none. Facts of such files meet in joins by their id."""
        if "repeated" not in self.made:
            self.made["repeated"] = materialize(self.files.filter("file_id IS NOT NULL").groupBy("file_id").count().filter("count > 1").select("file_id"), "repeated")
            self.made["any_repeated"] = None if self.made["repeated"].isEmpty() else self.made["repeated"]
        return self.made["any_repeated"]

    def with_ids(self, how: str) -> DataFrame:
        """The files whose id is repeated (``left_semi``), or is not (``left_anti``)."""
        files, repeated = self.files.filter("file_id IS NOT NULL"), self.repeated
        if repeated is None:
            return files
        return files.join(F.broadcast(repeated) if is_small(repeated) else large(repeated), "file_id", how)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A fact table that several facts and detectors read, written when the first one asks for it."""
        if name not in self.made:
            self.made[name] = materialize(build(), name)
        return self.made[name]

    def with_files(self, facts: DataFrame, keep: list[str], *more: str) -> DataFrame:
        """Facts with columns of their file."""
        wanted = list(dict.fromkeys(["file_id", *keep, *more]))
        return facts.join(large(self.files.select(*wanted)), "file_id") if len(wanted) > 1 else facts


def lex(files: DataFrame, keep: list[str], only: Sequence[str] | None = None) -> Lexed:
    """``files`` (file_id, rel, code) for facts. Functions are read where files are cut into tokens, other facts from the token table, which is written once.

    ``only`` names the facts of ``NEEDS`` that will be read; without it every column and token is kept.
    """
    kept = list(dict.fromkeys(["file_id", "rel", *keep]))
    base = files.select(*kept, "code")
    if only is None:
        return Lexed(base, None, tuple(kept))
    columns = {c for fact in only for c in NEEDS[fact][0].split()}
    wanted = " OR ".join(dict.fromkeys(f"({NEEDS[fact][1]})" for fact in only))
    return Lexed(base, None, tuple(kept), needs=(sorted(columns), wanted))


def mentioning(files: DataFrame, *lists: Sequence[str]) -> DataFrame:
    """Files whose text holds a word of every list, in capitals or not.

    Names and operators of facts are pieces of the text, so a rule that asks for one finds nothing in any other file,
    and those need not be cut into tokens.
    """
    text = F.lower("code")
    for words in lists:
        some = F.lit(False)
        for word in sorted({w.lower() for w in words}):
            some = some | F.contains(text, F.lit(word))
        files = files.filter(some)
    return files


def place_id(file_id: Column, place: Column) -> Column:
    return F.when(place.isNotNull(), F.concat_ws(":", file_id.cast("string"), place["line"].cast("string"), place["col"].cast("string")))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\"'`]|[\"'`]\z", "")


def _op(*words: str) -> Column:
    return (F.col("k") == "op") & F.col("t").isin(*words)


def _in_order(value: Column) -> Column:
    """Token texts of a group in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), value.alias("v")))), lambda x: x["v"])


def _line_of(code: Column, line: Column) -> Column:
    return F.get(F.split(code, "\n", -1), line - 1)


# ---- what the facts read of the token table ------------------------------------------------------------


def _quoted(words: Sequence[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# tokens at which a function can start: its keyword, bracket or only parameter, async, the name it is given, a method's part
_STARTS = "t IN ('(', 'function', 'async') OR next = '=>' OR (k = 'id' AND n1 IN ('=', ':')) OR (up = '{' AND pos = smin)"
_ASKED = "chain_k = 'id' AND k = 'id' AND (lower(t) LIKE '%procedure' OR t = 'input')"
_PATTERNS = "up IN ('{', '[') AND up_up = '('"
_HEADS = "k = 'id' AND pos = chain"
_ROOTED = f"chain_k = 'id' AND chain_t IN ({_quoted(rules.REQUEST_ROOTS)})"
# names between braces that an import takes, or that an export clause lists
_IMPORTED = "up = '{' AND up_n2 IN ('from', '=')"
_EXPORTED = "up = '{' AND up_prev1 = 'export'"
_OPTIONS = "up = '{' AND up_prev1 IN ('(', ',')"
_ITEMS = "up = '[' AND up_prev1 = ':'"
_OBJECT = "up = '{' AND up_prev1 = '='"
_CHAIN_COLUMNS = "pos t k l1 chain chain_k chain_t chain_before chain_line chain_col chain_call inside region"
_FUNCTION_COLUMNS = ("pos t k line col start smin par lvl linked logical last last_line last_end next prev1 prev3 l1 l1_k l1_pos l2 l2_pos n1 n1_pos n2 n2_pos n2_line n2_end "
                     "n3_pos n3_line n3_end typed typed_pos up up_prev1 up_prev2 up_up up_chain chain chain_k")
_FUNCTION_TOKENS = f"{_STARTS} OR t IN ('=>', '=', ':') OR up = '(' OR ({_PATTERNS}) OR ({_ASKED})"

# the columns and the tokens that each fact is read from
NEEDS = {
    "functions": (_FUNCTION_COLUMNS, _FUNCTION_TOKENS),
    "calls": (f"{_FUNCTION_COLUMNS} {_CHAIN_COLUMNS} run run_t run_line run_col run_before", f"{_FUNCTION_TOKENS} OR ({_HEADS}) OR ({_ROOTED}) OR ({_OPTIONS}) OR ({_ITEMS})"),
    "bindings": (f"{_FUNCTION_COLUMNS} {_CHAIN_COLUMNS} run_line run_col typed_line typed_col",
                 f"{_FUNCTION_TOKENS} OR t IN ({_quoted(tok.ASSIGNMENTS)}) OR ({_HEADS}) OR ({_ROOTED}) OR (chain_k = 'id' AND chain_t = 'Math')"),
    "imports": (f"{_CHAIN_COLUMNS} lvl linked par up up_prev1 up_n2 l1_pos l2 l2_k l2_pos n1 n1_pos n2",
                f"t IN ('{{', '}}', 'from', 'require') OR ({_IMPORTED}) OR (up = '(' AND up_prev1 = 'require') OR (chain_k = 'id' AND chain_t = 'require')"),
    "exports": (f"{_FUNCTION_COLUMNS} {_CHAIN_COLUMNS} l1_chain",
                f"{_FUNCTION_TOKENS} OR t IN ('{{', 'const', 'let', 'var', 'default') OR ({_EXPORTED}) OR ({_OBJECT}) OR (chain_k = 'id' AND chain_t IN ('module', 'exports'))"),
}


# ---- groups of tokens --------------------------------------------------------------------------------


def chains(lexed: Lexed) -> DataFrame:
    return lexed.once("chains", lambda: _chains(lexed.tokens))


def chains_from(lexed: Lexed, roots: Sequence[str]) -> DataFrame:
    """``chains`` that start with one of ``roots``; only their tokens are grouped."""
    return _chains(lexed.tokens.filter(F.col("chain_t").isin(*roots)))


def _names_flowing(lexed: Lexed) -> DataFrame:
    """The chains through which taint can enter what is around them: file_id, inside, region, chain, flows.

    Only operands that start at a request are grouped; any other one is told by its head: it flows if it calls nothing.
    """
    shown = ["file_id", "inside", "region", "chain", "flows"]
    root = F.col("t")
    plain = lexed.tokens.filter(_HEADS).filter(~root.isin(rules.REQUEST_ROOTS) & ~root.isin(_NOT_NAMES) & F.col("chain_call").isNull())
    plain = plain.filter(~F.coalesce(F.col("l1") == "!", F.lit(False))).withColumn("flows", root)
    return plain.select(*shown).unionByName(chains_from(lexed, rules.REQUEST_ROOTS).filter("flows is not null").select(*shown))


def _chains(tokens: DataFrame) -> DataFrame:
    """One row per operand that starts with a name: its names in order, whether it calls, and what it stands for.

    ``flows`` is the name through which taint enters: the first name of an operand without calls, or ``SOURCE``
    for request data. Operands behind ``!`` carry nothing.
    """
    grouped = tokens.filter("chain_k = 'id'").groupBy("file_id", "chain").agg(
        F.first("chain_t").alias("root"), F.first("chain_before").alias("before"), F.first("chain_line").alias("line"), F.first("chain_col").alias("col"),
        F.min_by(F.struct("inside", "region"), "pos").alias("at"), F.min(F.when(_op("("), F.col("pos"))).alias("call"),
        F.array_sort(F.collect_list(F.struct("pos", "t", "k"))).alias("tokens"))
    names = F.transform(F.filter("tokens", lambda x: x["k"] == "id"), lambda x: x["t"])
    until = F.size(F.filter("tokens", lambda x: (x["k"] == "id") & (F.col("call").isNull() | (x["pos"] < F.col("call")))))
    rows = grouped.withColumns({"names": names, "until": until})
    called = F.get("names", F.col("until") - 1)
    rooted = F.col("root").isin(rules.REQUEST_ROOTS)

    def has_property(upto: Column) -> Column:
        return F.arrays_overlap(F.slice("names", F.lit(2), F.greatest(upto, F.lit(0))), F.array(*[F.lit(p) for p in rules.REQUEST_PROPERTIES]))
    member = rooted & F.col("call").isNull() & has_property(F.size("names") - 1)
    request_call = rooted & F.col("call").isNotNull() & (F.col("until") > 1) & (
        called.isin(rules.REQUEST_BODY_CALLS) | (called.isin(rules.REQUEST_GETTERS) & has_property(F.col("until") - 2)))
    flows = F.when(F.coalesce(F.col("before") == "!", F.lit(False)), None).when(member | request_call, F.lit(SOURCE)).when(
        F.col("call").isNull() & ~F.col("root").isin(_NOT_NAMES), F.col("root"))
    return rows.select("file_id", "chain", "root", "line", "col", "call", "names", "at.*", flows.alias("flows"), member.alias("is_member"),
                       request_call.alias("is_request_call"), F.array_join(F.transform("tokens", lambda x: x["t"]), "").alias("text"),
                       F.array_join(F.transform(F.filter("tokens", lambda x: F.col("call").isNull() | (x["pos"] <= F.col("call"))), lambda x: x["t"]), "").alias("upto_call"))


def _parts(rows: DataFrame) -> DataFrame:
    """Parts of brackets: their tokens of this level in order, without the separators."""
    return rows.filter(~_op(",", ";")).groupBy("file_id", "par", "smin").agg(
        F.first("last").alias("last"), F.array_sort(F.collect_list(F.struct("pos", "t", "k"))).alias("tokens"))


def _insides(rows: DataFrame) -> DataFrame:
    """The text of brackets, nested ones left out, as tokens with blanks between."""
    return rows.groupBy("file_id", "par").agg(F.array_join(_in_order(F.col("t")), " ").alias("text"))


def _flowing(lexed: Lexed, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` (file_id, inside, region, from, to) with the names inside them that share their region.

    A region is part of one statement, so a name meets only the spans around it and beside it.
    """
    hits = spans.join(large(_names_flowing(lexed)), ["file_id", "inside", "region"]).filter("chain >= `from` AND chain <= `to`")
    found = hits.groupBy(*keys).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("chain", "flows"))), lambda x: x["flows"])).alias("_flow"))
    none = F.array().cast("array<string>")
    flow = F.coalesce("_flow", none)
    return spans.join(large(found), keys, "left").withColumns({"refs": F.filter(flow, lambda n: n != SOURCE), "has_source": F.array_contains(flow, SOURCE)}).drop("_flow")


# ---- functions ---------------------------------------------------------------------------------------


def _function_spans(lexed: Lexed) -> DataFrame:
    """Where functions start and end, their kind, name and parameters' place."""
    t = lexed.tokens
    anchor = t.filter("(t = '(' AND k = 'op') OR (k = 'id' AND next = '=>')").select(
        "file_id", F.col("pos").alias("at"), F.col("t").alias("anchor"), F.col("l1").alias("a1"), F.col("l1_pos").alias("a1_pos"), F.col("l2").alias("a2"),
        F.col("l2_pos").alias("a2_pos"), F.col("n2").alias("after"), F.col("n3_pos").alias("b_end"), F.col("n3_line").alias("b_line"), F.col("n3_end").alias("b_off"),
        F.col("last").alias("p_end"), F.col("last_line").alias("p_line"), F.col("last_end").alias("p_off"), "par", "smin", "lvl")

    def ends(braced: Column, place: Column, line: Column, offset: Column) -> Column:
        return F.when(braced, F.struct(place.alias("end"), line.alias("end_line"), offset.alias("end_off"))).otherwise(
            F.struct(F.col("p_end").alias("end"), F.col("p_line").alias("end_line"), F.col("p_off").alias("end_off")))
    own_end = ends(F.col("after") == "{", F.col("b_end"), F.col("b_line"), F.col("b_off"))
    keyword = t.filter("t = 'function' AND k = 'id' AND NOT linked").select(
        "file_id", F.when(F.col("n1") == "(", F.col("n1_pos")).when(F.col("n2") == "(", F.col("n2_pos")).otherwise(F.col("n3_pos")).alias("at"), F.col("pos").alias("word"),
        F.when(F.col("n1").rlike("^[A-Za-z_$]"), F.col("n1")).when((F.col("n1") == "*") & (F.col("n2") != "("), F.col("n2")).alias("own"),
        F.col("l1").alias("b1"), F.col("l1_pos").alias("b1_pos"), F.col("l2").alias("b2"), F.col("l2_pos").alias("b2_pos"))
    keyword = keyword.join(large(anchor), ["file_id", "at"]).select(
        "file_id", "at", F.lit("function").alias("kind"), "own", "word", "b1", "b1_pos", "b2", "b2_pos", own_end.alias("e"), F.lit(None).cast("int").alias("from_part"))

    arrows = t.filter("t = '=>' AND k = 'op'")
    typed_result = F.col("l2").isin(":", "|", "&", "<", ",", ".") | (F.col("l1").isin(">", "]", "}") | F.col("l1_k").isin("string"))
    body = F.when(F.col("n1") == "{", F.struct(F.col("n2_pos").alias("end"), F.col("n2_line").alias("end_line"), F.col("n2_end").alias("end_off"))).otherwise(
        F.struct(F.col("last").alias("end"), F.col("last_line").alias("end_line"), F.col("last_end").alias("end_off")))
    arrows = arrows.select("file_id", F.col("pos").alias("arrow"), "par", "smin", body.alias("e"), F.when(F.col("l1") == ")", F.col("l2_pos")).when(
        ~F.coalesce(typed_result, F.lit(False)) & (F.col("l1_k") == "id"), F.col("l1_pos")).alias("at"))
    # the parameters of an arrow with a result type are the last bracket before it in the part
    typed = (arrows.filter("at IS NULL").drop("at").join(large(anchor.filter("anchor = '('").select("file_id", "par", "smin", F.col("at"))), ["file_id", "par", "smin"])
             .filter("at < arrow").groupBy("file_id", "arrow").agg(F.first("e").alias("e"), F.max("at").alias("at")))
    arrows = arrows.filter("at IS NOT NULL").select("file_id", "at", "e").unionByName(typed.select("file_id", "at", "e"))
    arrows = arrows.join(large(anchor), ["file_id", "at"]).select("file_id", "at", F.lit("arrow").alias("kind"), F.lit(None).cast("string").alias("own"), F.col("at").alias("word"),
                                                         F.col("a1").alias("b1"), F.col("a1_pos").alias("b1_pos"), F.col("a2").alias("b2"), F.col("a2_pos").alias("b2_pos"), "e",
                                                         F.lit(None).cast("int").alias("from_part"))

    methods = t.filter("t = '(' AND k = 'op' AND l1_k = 'id' AND up = '{' AND (n2 = '{' OR (n2 = ':' AND NOT logical))").filter(
        ~F.col("l1").isin(spans.NOT_METHODS) & ~F.coalesce(F.col("l2").isin("function", "new", *_DOTS, "=", "return", "await"), F.lit(False))
        & ~F.coalesce((F.col("l2") == "*") & (F.col("prev3") == "function"), F.lit(False))).select(
        "file_id", F.col("pos").alias("at"), F.lit("method").alias("kind"), F.col("l1").alias("own"), F.col("l1_pos").alias("word"), F.col("l2").alias("b1"), F.col("l2_pos").alias("b1_pos"),
        F.lit(None).cast("string").alias("b2"), F.lit(None).cast("int").alias("b2_pos"),
        F.when(F.col("n2") == "{", F.struct(F.col("n3_pos").alias("end"), F.col("n3_line").alias("end_line"), F.col("n3_end").alias("end_off"))).otherwise(
            F.struct(F.col("last").alias("end"), F.col("last_line").alias("end_line"), F.col("last_end").alias("end_off"))).alias("e"), F.col("smin").alias("from_part"))

    every = keyword.unionByName(arrows).unionByName(methods).withColumn("is_async", F.coalesce(F.col("b1") == "async", F.lit(False)))
    named_by = F.when(F.col("kind") == "method", None).when(F.col("is_async"), F.when(F.col("b2").isin("=", ":"), F.col("b2_pos"))).when(F.col("b1").isin("=", ":"), F.col("b1_pos"))
    every = every.withColumn("named_by", named_by)
    given = t.filter(_op("=", ":")).select("file_id", F.col("pos").alias("named_by"), *_given())
    every = every.join(large(given), ["file_id", "named_by"], "left")
    start = F.coalesce("given_pos", F.when(F.col("kind") == "method", F.col("from_part")).when(F.col("is_async"), F.col("b1_pos")).otherwise(F.col("word")))
    every = every.withColumns({"start": start, "name": F.coalesce("given", "own")})
    places = t.filter(_STARTS).select("file_id", F.col("pos").alias("start"), "line", "col", F.col("start").alias("start_off"), "up", "up_prev1", "up_prev2", "up_chain", "prev1")
    return every.join(large(places), ["file_id", "start"]).select("file_id", "start", "e.*", "line", "col", "start_off", "kind", "name", "is_async", F.col("at").alias("params_at"),
                                                        "up", "up_prev1", "up_prev2", "up_chain", "prev1")


def _given() -> list[Column]:
    """The name that an assignment or a colon gives its value to, and the name's place."""
    typed = (F.col("t") != ":") & F.col("typed").isNotNull() & (F.col("typed_pos") - F.col("smin") <= 2) & (F.col("typed_pos") != F.col("l1_pos"))
    return [F.when(typed, F.col("typed")).when(F.col("l1_k") == "id", F.col("l1")).alias("given"),
            F.when(typed, F.col("typed_pos")).when(F.col("l1_k") == "id", F.col("l1_pos")).alias("given_pos")]


def _bound_names(pattern: Column) -> Column:
    """Names bound by a destructured parameter: shorthand, renamed and rest entries."""
    named = F.transform(F.split(pattern, ","), lambda x: F.regexp_extract(x, rf"^\s*(?:\.\.\.\s*|{NAME}\s*:\s*)?({NAME})(?:\s*=.*)?\s*\z", 1))
    return F.filter(named, lambda n: n != "")


def _input_names(pattern: Column) -> Column:
    wanted = "|".join(rules.PROCEDURE_INPUTS)
    named = F.transform(F.split(pattern, ","), lambda x: F.regexp_extract(x, rf"^\s*((?:{wanted}))(?:\s*:\s*({NAME}))?\s*(?:=.*)?\z", 0))
    return F.transform(F.filter(named, lambda n: n != ""), lambda n: F.regexp_extract(n, rf"({NAME})\s*(?:=.*)?\z", 1))


def _all_functions(lexed: Lexed) -> DataFrame:
    return lexed.once("functions", lambda: _functions(lexed))


def _part_words(tokens: Column) -> tuple[Column, Column]:
    """The text of a parameter without decorators and modifiers, and its decorators."""
    text = F.concat(F.array_join(F.transform(tokens, lambda x: x["t"]), " "), F.lit(" "))
    bare = F.regexp_replace(F.regexp_replace(text, rf"@ {NAME} (?:\. {NAME} )*(?:\( \) )?", ""), rf"^(?:(?:{_MODIFIERS}) )*", "")
    decorators = F.transform(F.filter(tokens, lambda x, i: F.coalesce(F.get(tokens, i - 1)["t"] == "@", F.lit(False))), lambda x: x["t"])
    return bare, decorators


def _first_name(bare: Column) -> Column:
    return F.nullif(F.regexp_extract(bare, rf"^({NAME})", 1), F.lit(""))


def _functions(lexed: Lexed) -> DataFrame:
    """Function spans with parameters and with what frameworks hand them; ``src`` and columns of the file where its id is its own."""
    def parameter(part: Column) -> Column:
        bare, decorators = _part_words(part["tokens"])
        return F.struct(_first_name(bare).alias("name"), F.when(bare.rlike(r"^[{\[]"), F.coalesce(part["inner"], F.lit(""))).alias("pattern"), decorators.alias("decorators"))
    found = spans.function_rows(lexed.with_ids("left_anti"), lexed.keep)
    only = F.when(F.col("single").isNotNull(), F.array(F.struct(F.col("single").alias("name"), F.lit(None).cast("string").alias("pattern"), F.array().cast("array<string>").alias("decorators"))))
    fns = _handed(found.withColumn("params", F.when(F.size("parts") > 0, F.transform("parts", parameter)).otherwise(F.coalesce(only, F.array().cast(_PARAMETERS)))).drop("parts", "single"))
    if lexed.repeated is not None:
        fns = fns.unionByName(_joined_functions(Lexed(lexed.with_ids("left_semi"), None, lexed.keep)), allowMissingColumns=True)
    return fns


_PARAMETERS = "array<struct<name: string, pattern: string, decorators: array<string>>>"


def _joined_functions(lexed: Lexed) -> DataFrame:
    """Functions by joins over tokens, for files that share an id."""
    found, t = materialize(_function_spans(lexed), "spans"), lexed.tokens
    within = _insides(t.filter(_PATTERNS)).select("file_id", F.col("par").alias("opened"), F.col("text").alias("inner"))
    parts = _parts(t.filter("up = '('")).withColumnRenamed("par", "params_at").join(large(found.select("file_id", "params_at").distinct()), ["file_id", "params_at"])
    bare, decorators = _part_words(F.col("tokens"))
    opened = F.when(bare.rlike(r"^[{\[]"), F.get(F.filter("tokens", lambda x: x["t"].isin("{", "[")), F.lit(0))["pos"])
    params = parts.select("file_id", "params_at", "smin", _first_name(bare).alias("name"), opened.alias("opened"), decorators.alias("decorators"))
    params = params.join(large(within), ["file_id", "opened"], "left").withColumn("pattern", F.when(F.col("opened").isNotNull(), F.coalesce("inner", F.lit(""))))
    listed = params.groupBy("file_id", "params_at").agg(F.transform(F.array_sort(F.collect_list(F.struct("smin", F.struct("name", "pattern", "decorators").alias("p")))),
                                                                    lambda x: x["p"]).alias("params"))
    # the only parameter of an arrow without brackets is its own anchor
    single = t.filter("k = 'id' AND next = '=>'").select("file_id", F.col("pos").alias("params_at"), F.array(F.struct(
        F.col("t").alias("name"), F.lit(None).cast("string").alias("pattern"), F.array().cast("array<string>").alias("decorators"))).alias("single"))
    fns = found.join(large(listed), ["file_id", "params_at"], "left").join(large(single), ["file_id", "params_at"], "left")
    fns = fns.withColumn("params", F.coalesce("params", "single", F.array().cast(_PARAMETERS)))
    asked = t.filter(_ASKED).select("file_id", F.col("chain").alias("up_chain")).distinct().withColumn("asked", F.lit(True))
    return _handed(fns.join(large(asked), ["file_id", "up_chain"], "left").drop("single"))


def _handed(fns: DataFrame) -> DataFrame:
    """Functions with the names that frameworks hand them."""
    none = F.array().cast("array<string>")
    first, second = F.get("params", F.lit(0)), F.get("params", F.lit(1))
    in_map = (F.col("up") == "{") & (F.col("up_prev1") == ":") & _unquoted(F.col("up_prev2")).isin(rules.GRAPHQL_MAPS) & F.col("name").isNotNull()
    resolver = F.when(in_map & second.isNotNull(), F.when(second["name"].isNotNull(), F.array(second["name"])).otherwise(F.coalesce(_bound_names(second["pattern"]), none)))
    asked_by = F.col("up_prev1").isin(rules.PROCEDURE_CALLS) & (F.col("up_prev2") == ".") & (F.col("up") == "(") & (F.col("prev1") == "(") & F.col("asked")
    procedure = F.when(asked_by, F.coalesce(_input_names(first["pattern"]), none))
    handed = F.array(*[F.lit(d) for d in rules.INPUT_DECORATORS])
    decorated = F.transform(F.filter("params", lambda p: p["name"].isNotNull() & F.arrays_overlap(p["decorators"], handed)), lambda p: p["name"])
    fns = fns.withColumns({"resolver": F.coalesce(resolver, none), "procedure": F.coalesce(procedure, none), "decorated": decorated})
    return fns.withColumn("is_carrier", F.col("name").isNotNull() | (F.size("resolver") > 0) | (F.size("procedure") > 0)).drop("asked")


def _enclosed(points: DataFrame, fns: DataFrame, out: str, carrier: bool = False) -> DataFrame:
    """``points`` (file_id, p) with the place of the nearest function around them.

    Functions nest, so a running count of open ones gives the depth, and the latest one that reached a depth is
    the one around everything there. Only facts and functions take part, not tokens.
    """
    around = fns.filter("is_carrier") if carrier else fns
    payload = F.struct(*points.columns)
    rows = points.select("file_id", F.col("p").alias("_p"), F.lit(0).alias("_kind"), payload.alias("_row"), F.lit(None).cast("struct<line: int, col: int>").alias("_fn"))
    empty = F.lit(None).cast(points.select(payload.alias("r")).schema["r"].dataType)
    starts = around.select("file_id", F.col("start").alias("_p"), F.lit(1).alias("_kind"), empty.alias("_row"), F.struct("line", "col").alias("_fn"))
    ends = around.select("file_id", F.col("end").alias("_p"), F.lit(2).alias("_kind"), empty.alias("_row"), F.lit(None).cast("struct<line: int, col: int>").alias("_fn"))
    order = Window.partitionBy("file_id").orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("_kind") == 1, 1).when(F.col("_kind") == 2, -1).otherwise(0)
    depth = rows.unionByName(starts).unionByName(ends).withColumn("_depth", F.sum(move).over(order))
    level = Window.partitionBy("file_id", "_depth").orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = depth.filter("_kind < 2").withColumn("_around", F.last("_fn", ignorenulls=True).over(level))
    return found.filter("_kind = 0").select("_row.*", F.when(F.col("_depth") > 0, F.col("_around")).alias(out))


def functions_of(lexed: Lexed, keep: list[str], with_parent: bool = True, stored: bool = True) -> DataFrame:
    """Functions with columns of their file. ``with_parent`` looks for the function around each one, in a shuffle.

    They are ``stored`` for other facts and detectors; a query that reads them only once need not write them.
    """
    fns = _all_functions(lexed) if stored else _functions(lexed)
    own = [c for c in lexed.keep if c != "file_id"]
    src = F.substring(F.col("code"), F.col("start_off") + 1, F.col("end_off") - F.col("start_off"))
    here, parent = F.struct("line", "col"), []
    if with_parent:
        slim = fns.select("file_id", "start", "end", "line", "col", "is_carrier", F.struct(*fns.columns).alias("fn"), F.col("start").alias("p"))
        fns = _enclosed(slim.select("file_id", "p", "fn"), slim, "parent").select("fn.*", "parent")
        parent = [place_id(F.col("file_id"), F.col("parent")).alias("parent_fn")]
    if lexed.repeated is not None:
        again = fns.join(F.broadcast(lexed.repeated) if is_small(lexed.repeated) else large(lexed.repeated), "file_id", "left_semi").drop("src", *own)
        fns = (fns.join(F.broadcast(lexed.repeated) if is_small(lexed.repeated) else large(lexed.repeated), "file_id", "left_anti")
               .unionByName(lexed.with_files(again, own, "code").withColumn("src", src).drop("code")))
    rest = ["is_carrier", "params", "resolver", "procedure", "decorated", "start", "end", "src"]
    return fns.select(place_id(F.col("file_id"), here).alias("fn_id"), "file_id", *keep, "name", "kind", "is_async", F.col("line").alias("start_line"), "end_line", "col", *parent, *rest)


def params_of(lexed: Lexed) -> DataFrame:
    fns = _all_functions(lexed).select(place_id(F.col("file_id"), F.struct("line", "col")).alias("fn_id"), F.posexplode("params").alias("pos", "p"))
    return fns.select("fn_id", "pos", "p.name", "p.pattern", "p.decorators")


# ---- calls -------------------------------------------------------------------------------------------


def _call_rows(lexed: Lexed) -> DataFrame:
    """Opening brackets that call a name: not definitions, not constructors, not control words."""
    chained = F.coalesce(F.col("l2").isin(_DOTS), F.lit(False))
    alone = (F.col("run") == F.col("l1_pos")) & ~chained
    defined = (F.col("n2") == "{") | ((F.col("n2") == ":") & ~F.col("logical") & F.coalesce(F.col("up") == "{", F.lit(True)) & ~F.coalesce(F.col("chain_before").isin("case", ":"), F.lit(False))
                                      & (F.col("last") > F.col("n2_pos") + 2) & alone & (F.col("smin") == F.col("run")))
    rows = lexed.tokens.filter("t = '(' AND k = 'op' AND linked AND l1_k = 'id'").filter(
        ~F.coalesce(defined, F.lit(False)) & ~F.coalesce(F.col("l2").isin("function", "new") | (F.col("chain_before") == "new"), F.lit(False))
        & ~F.coalesce((F.col("l2") == "*") & (F.col("prev3") == "function"), F.lit(False)) & ~(alone & F.col("l1").isin(_NOT_CALLED)))
    one_step = (F.col("l1_pos") - F.col("run") == 2) & ~F.coalesce(F.col("run_before").isin(_DOTS), F.lit(False))
    return rows.select("file_id", F.col("pos").alias("call"), F.when(alone, "id").otherwise("member").alias("callee_kind"), F.when(one_step, F.col("run_t")).alias("obj"),
                       F.col("l1").alias("name"), F.col("run_line").alias("line"), F.col("run_col").alias("col"), F.col("run").alias("p"), "inside", "region")


def _argument_kind() -> Column:
    first, last, n = F.get("tokens", F.lit(0)), F.element_at("tokens", -1), F.size("tokens")

    def some(test) -> Column:
        return F.exists("tokens", test)
    template = (first["k"] == "template") & F.forall("tokens", lambda x: (x["k"] == "template") | (x["t"] == "}"))
    words = F.forall("tokens", lambda x: (x["k"] == "id") | x["t"].isin(*_DOTS, "[", "]"))
    return (F.when((n == 1) & (first["k"] == "string"), "string").when(template, F.when(n > 1, "template").otherwise("plain-template"))
            .when(some(lambda x: (x["k"] == "op") & (x["t"] == "=>")) | (first["t"] == "function") | ((first["t"] == "async") & (F.get("tokens", F.lit(1))["t"] == "function")), "function")
            .when(some(lambda x: (x["k"] == "op") & x["t"].isin("||", "&&", "??", "?")), "logical").when(some(lambda x: (x["k"] == "op") & (x["t"] == "+")), "plus")
            .when(first["t"] == "{", "object").when(first["t"] == "[", "array").when(first["k"] == "number", "number").when((n == 1) & (first["k"] == "id"), "identifier")
            .when(first["t"] == "await", "await").when((first["k"] == "id") & (first["t"] != "new") & (last["t"] == ")"), "call").when(words & (first["k"] == "id"), "member").otherwise("other"))


def _entries(lexed: Lexed) -> DataFrame:
    """Keys and value texts of objects that stand as arguments, by the object's brace."""
    t = lexed.tokens
    lists = _insides(t.filter(_ITEMS)).select("file_id", F.col("par").alias("list"), F.col("text").alias("items"))
    parts = _parts(t.filter(_OPTIONS))
    key, value = F.get("tokens", F.lit(0)), F.when(F.get("tokens", F.lit(1))["t"] == ":", F.slice("tokens", F.lit(3), F.size("tokens")))
    text = F.array_join(F.transform(value, lambda x: x["t"]), " ")
    rows = parts.filter(key["k"].isin("id", "string")).select("file_id", "par", "smin", _unquoted(key["t"]).alias("key"), F.coalesce(text, F.lit("")).alias("value"),
                                                             F.when(F.get(value, F.lit(0))["t"] == "[", F.get(value, F.lit(0))["pos"]).alias("list"))
    rows = rows.join(large(lists), ["file_id", "list"], "left").withColumn("value", F.when(F.col("list").isNotNull(), F.concat(F.lit("["), F.coalesce("items", F.lit("")), F.lit("]"))).otherwise(F.col("value")))
    return rows.groupBy("file_id", F.col("par").alias("object")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("smin", F.struct("key", "value").alias("e")))), lambda x: x["e"]).alias("entries"))


def _argument_rows(lexed: Lexed, calls: DataFrame) -> DataFrame:
    parts = _parts(lexed.tokens.filter("up = '('")).withColumnRenamed("par", "call").join(large(calls.select("file_id", "call", "inside", "region")), ["file_id", "call"])
    # read twice, for the names that flow into it and for what it is
    parts = materialize(parts, "arguments")
    spans = _flowing(lexed, parts.withColumns({"from": F.col("smin"), "to": F.col("last")}), ["file_id", "call", "smin"])
    kind = _argument_kind()
    rows = spans.withColumn("kind", kind)
    first = F.get("tokens", F.lit(0))
    rows = rows.select("file_id", "call", "smin", "kind", F.when(F.col("kind") == "string", _unquoted(first["t"])).alias("literal"),
                       F.when(F.col("kind") == "call", F.element_at(F.filter("tokens", lambda x: x["k"] == "id"), -1)["t"]).alias("callee"), "refs", "has_source",
                       F.when(F.col("kind") == "object", first["pos"]).alias("object"))
    return rows.join(large(_entries(lexed)), ["file_id", "object"], "left")


def _calls(lexed: Lexed) -> DataFrame:
    """Calls with their arguments and the functions around them."""
    calls = _call_rows(lexed)
    given = _argument_rows(lexed, calls)
    args = given.groupBy("file_id", "call").agg(F.transform(F.array_sort(F.collect_list(F.struct("smin", F.struct(
        "kind", "literal", "callee", "refs", "has_source", "entries").alias("a")))), lambda x: x["a"]).alias("args"))
    args = materialize(args, "args")
    none = F.array().cast(args.schema["args"].dataType)
    rows = calls.drop("inside", "region").join(large(args), ["file_id", "call"], "left").withColumn("args", F.coalesce("args", none))
    fns = _all_functions(lexed)
    return _enclosed(_enclosed(rows, fns, "fn"), fns, "carrier", carrier=True)


def calls_of(lexed: Lexed, keep: list[str], with_line: bool = True) -> DataFrame:
    rows = lexed.with_files(lexed.once("calls", lambda: _calls(lexed)), keep, *(["code"] if with_line else []))
    here, line = F.struct("line", "col"), [_line_of(F.col("code"), F.col("line")).alias("source_line")] if with_line else []
    return rows.select(place_id(F.col("file_id"), here).alias("call_id"), "file_id", *keep, place_id(F.col("file_id"), F.col("fn")).alias("fn_id"),
                       place_id(F.col("file_id"), F.col("carrier")).alias("carrier_fn"), "callee_kind", "obj", "name", "line", "col", "args", "p", *line)


def call_args_of(lexed: Lexed) -> DataFrame:
    rows = calls_of(lexed, [], with_line=False).select("call_id", "file_id", "carrier_fn", F.posexplode("args").alias("pos", "a"))
    return rows.select("call_id", "file_id", "carrier_fn", "pos", "a.kind", "a.literal", "a.refs", "a.has_source",
                       F.col("a.kind").isin("plus", "template").alias("is_built"))


# ---- bindings, comparisons ---------------------------------------------------------------------------


def _bindings(lexed: Lexed) -> DataFrame:
    """Names and what their values refer to; ``draws_random`` tells of Math.random() anywhere in the value."""
    t = lexed.tokens
    typed = F.col("typed").isNotNull() & (F.col("typed_pos") - F.col("smin") <= 2) & (F.col("typed_pos") != F.col("l1_pos"))
    simple = (F.col("l1_k") == "id") & ~F.coalesce(F.col("l2").isin(_DOTS), F.lit(False)) & ~F.col("l1").isin(_NOT_NAMES)
    rows = t.filter((F.col("k") == "op") & F.col("t").isin(tok.ASSIGNMENTS) & (typed | simple)).select(
        "file_id", F.col("pos").alias("assign"), F.when(typed, F.col("typed")).otherwise(F.col("l1")).alias("lhs"),
        F.when(typed, F.col("typed_line")).otherwise(F.col("run_line")).alias("line"), F.when(typed, F.col("typed_col")).otherwise(F.col("run_col")).alias("col"),
        F.when(typed, F.col("typed_pos")).otherwise(F.col("l1_pos")).alias("p"), "inside", "region", (F.col("pos") + 1).alias("from"),
        # a value with a logical or arrow operator carries nothing
        F.when(F.col("logical"), F.lit(-1)).otherwise(F.col("last")).alias("to"), F.col("last").alias("value_end"))
    rows = _flowing(lexed, rows, ["file_id", "assign"])
    random = chains_from(lexed, ["Math"]).filter("names[1] = 'random' AND call IS NOT NULL").select("file_id", F.col("chain").alias("drawn"))
    drawing = rows.select("file_id", "assign", "value_end").join(large(random), "file_id").filter("drawn > assign AND drawn <= value_end").select("file_id", "assign").distinct()
    rows = rows.join(large(drawing.withColumn("draws_random", F.lit(True))), ["file_id", "assign"], "left").withColumn("draws_random", F.coalesce("draws_random", F.lit(False)))
    return _enclosed(rows, _all_functions(lexed), "fn")


def bindings_of(lexed: Lexed, keep: list[str] | None = None, with_line: bool = True) -> DataFrame:
    keep = keep or []
    rows = lexed.with_files(lexed.once("bindings", lambda: _bindings(lexed)), keep, *(["code"] if with_line else []))
    line = [_line_of(F.col("code"), F.col("line")).alias("source_line")] if with_line else []
    return rows.select("file_id", *keep, place_id(F.col("file_id"), F.col("fn")).alias("fn_id"), "line", "col", "lhs", "refs", "has_source", "draws_random", *line)


def comparisons_of(lexed: Lexed, keep: list[str]) -> DataFrame:
    # where files share an id, a comparison can meet the operands of another file
    sides = _chains(lexed.tokens.filter("beside")) if lexed.repeated is None else chains(lexed)
    operands = materialize(sides, "sides").select("file_id", "chain", "call", "text", F.col("line").alias("l"), F.col("col").alias("c"))
    named = F.regexp_extract("text", rf"(?:^|\.)({NAME})\z", 1)
    left = operands.select("file_id", F.col("chain").alias("l1_chain"), F.col("call").alias("l_call"), named.alias("l_name"), "l", "c")
    right = operands.select("file_id", F.col("chain").alias("n1_pos"), F.col("call").alias("r_call"), named.alias("r_name"))
    rows = lexed.tokens.filter(_op(*tok.COMPARED)).select("file_id", "pos", F.col("t").alias("op"), "line", "col", "l1", "l1_k", "l1_chain", "n1", "n1_pos").join(
        large(left), ["file_id", "l1_chain"], "left").join(large(right), ["file_id", "n1_pos"], "left")

    def literal(text: Column) -> Column:
        return F.when(text.rlike("^[\"']"), "string").when(text.rlike("^[0-9]"), "number")
    here = F.col("l").isNotNull() & F.col("l_call").isNull()
    rows = rows.select(
        "file_id", F.when(here, F.col("l")).otherwise(F.col("line")).alias("line"), F.when(here, F.col("c")).otherwise(F.col("col")).alias("col"), "op",
        F.when(here, F.col("l_name")).otherwise("").alias("left_name"), F.coalesce(literal(F.col("l1")), F.when(here, "name"), F.lit("other")).alias("left_kind"),
        F.when(F.col("r_call").isNull(), F.coalesce("r_name", F.lit(""))).otherwise("").alias("right_name"),
        F.coalesce(literal(F.col("n1")), F.when(F.col("r_call").isNotNull(), "call"), F.when(F.col("r_name").isNotNull(), "name"), F.lit("other")).alias("right_kind"))
    return lexed.with_files(rows, keep, "code").select("file_id", *keep, "line", "col", "op", "left_name", "left_kind", "right_name", "right_kind",
                                                     _line_of(F.col("code"), F.col("line")).alias("source_line"))


# ---- imports, exports --------------------------------------------------------------------------------


def _listed(names: Column, separator: str) -> Column:
    """(a, b) of every ``a``, ``a as b`` or ``a : b`` of a list; b defaults to a."""
    items = F.filter(F.split(names, ","), lambda x: x.rlike(rf"^\s*(?:type )?{NAME}(?:\s*{separator}\s*{NAME})?\s*\z"))
    return F.transform(items, lambda x: F.struct(F.regexp_extract(x, rf"^\s*(?:type )?({NAME})", 1).alias("a"), F.regexp_extract(x, rf"({NAME})\s*\z", 1).alias("b")))


def imports_of(lexed: Lexed, keep: list[str]) -> DataFrame:
    t = lexed.tokens
    braces = _insides(t.filter(_IMPORTED)).select("file_id", F.col("par").alias("opened"), F.col("text").alias("names"))
    begins = t.filter("t = '{' AND k = 'op' AND n2 = 'from'").select("file_id", F.col("pos").alias("opened"), F.col("l1").alias("o1"), F.col("l2").alias("o2"))
    froms = t.filter("t = 'from' AND lvl = 0 AND l1 IS NOT NULL").filter(F.col("n1").rlike("^[\"']")).select(
        "file_id", _unquoted(F.col("n1")).alias("source"), "l1", "l2", F.when(F.col("l1") == "}", F.col("l2_pos")).alias("opened"))
    froms = froms.join(large(braces), ["file_id", "opened"], "left").join(large(begins), ["file_id", "opened"], "left")

    def entry(local: Column, imported: Column) -> Column:
        return F.struct(local.alias("local"), imported.alias("imported"))
    default = F.when(F.col("l2").isin("import", "type"), F.col("l1")).when((F.col("o1") == ",") & F.col("o2").rlike(f"^{NAME}"), F.col("o2"))
    named = F.when(F.col("o1").isin("import", "type", ","), F.transform(_listed(F.col("names"), "as"), lambda x: entry(x["b"], x["a"])))
    none = F.array().cast("array<struct<local: string, imported: string>>")
    own = F.array_compact(F.array(F.when(default.isNotNull(), entry(default, F.lit("default"))), F.when(F.col("l2") == "as", entry(F.col("l1"), F.lit("*")))))
    es = froms.select("file_id", "source", F.explode(F.concat(own, F.coalesce(named, none))).alias("i"))

    required = t.filter("t = 'require' AND k = 'id' AND NOT linked AND l1 = '=' AND n1 = '('").select("file_id", F.col("pos").alias("chain"), F.col("n1_pos").alias("par"), "l2", "l2_k", "l2_pos")
    plain = chains_from(lexed, ["require"]).filter("text = 'require()'").select("file_id", "chain")
    arg = t.filter("up = '(' AND up_prev1 = 'require' AND k = 'string'").select("file_id", "par", _unquoted(F.col("t")).alias("source"))
    closes = t.filter("t = '}' AND k = 'op' AND n1 = '='").select("file_id", F.col("pos").alias("l2_pos"), F.col("l1_pos").alias("opened"))
    required = required.join(large(plain), ["file_id", "chain"]).join(large(arg), ["file_id", "par"]).join(large(closes), ["file_id", "l2_pos"], "left").join(large(braces), ["file_id", "opened"], "left")
    found = F.when(F.col("l2_k") == "id", F.array(entry(F.col("l2"), F.lit("*")))).when(F.col("l2") == "}", F.transform(_listed(F.col("names"), ":"), lambda x: entry(x["b"], x["a"])))
    cjs = required.select("file_id", "source", F.explode(F.coalesce(found, none)).alias("i"))
    rows = es.unionByName(cjs).select("file_id", "i.local", "source", "i.imported")
    return lexed.with_files(rows, ["rel", *keep]).select("file_id", "rel", *keep, "local", "source", "imported")


def _export_names(lexed: Lexed) -> DataFrame:
    """(file_id, export_name, local) of export statements and of assignments to the module's exports."""
    t = lexed.tokens
    braces = _insides(t.filter(_EXPORTED)).select("file_id", F.col("par").alias("opened"), F.col("text").alias("names"))

    def pairs(rows: DataFrame, name: Column, local: Column) -> DataFrame:
        return rows.select("file_id", name.alias("export_name"), local.alias("local"))
    word = F.when(F.col("n1") == "*", F.col("n2")).otherwise(F.col("n1"))
    before = F.when(F.col("l1") == "async", F.col("l2")).otherwise(F.col("l1"))
    fns = t.filter("t = 'function' AND k = 'id'").withColumns({"word": word, "before": before}).filter(F.col("word").rlike("^[A-Za-z_$]"))
    out = pairs(fns.filter("before = 'export'"), F.col("word"), F.col("word")).unionByName(pairs(fns.filter("before = 'default'"), F.lit("default"), F.col("word")))
    kept = t.filter("t IN ('const', 'let', 'var') AND l1 = 'export'").filter(F.col("n1").rlike("^[A-Za-z_$]"))
    out = out.unionByName(pairs(kept, F.col("n1"), F.col("n1")))
    ends = F.coalesce(F.col("n2") == ";", F.lit(True)) | (F.col("last") == F.col("n1_pos"))
    simple = F.col("n1").rlike("^[A-Za-z_$]") & ~F.col("n1").isin("async", "function", "class", "new") & ends
    out = out.unionByName(pairs(t.filter("t = 'default' AND l1 = 'export'").filter(simple), F.lit("default"), F.col("n1")))
    clause = t.filter("t = '{' AND k = 'op' AND l1 = 'export' AND (n2 IS NULL OR n2 <> 'from')").select("file_id", F.col("pos").alias("opened")).join(large(braces), ["file_id", "opened"])
    out = out.unionByName(clause.select("file_id", F.explode(_listed(F.col("names"), "as")).alias("x")).select("file_id", F.col("x.b").alias("export_name"), F.col("x.a").alias("local")))

    targets = chains_from(lexed, ["module", "exports"]).filter(r"text RLIKE '^(module\\.)?exports(\\.[A-Za-z_$][0-9A-Za-z_$]*)?$'").select("file_id", F.col("chain").alias("l1_chain"), "text")
    given = t.filter("t = '=' AND k = 'op'").select("file_id", "l1_chain", "n1", "n1_pos", "logical", ends.alias("ends"), simple.alias("simple")).join(large(targets), ["file_id", "l1_chain"])
    whole = given.filter("text IN ('exports', 'module.exports')")
    single = given.filter("text NOT IN ('exports', 'module.exports')").withColumn("member", F.element_at(F.split("text", r"\."), -1))
    out = out.unionByName(pairs(whole.filter("simple AND NOT logical"), F.lit("default"), F.col("n1")))
    out = out.unionByName(pairs(whole.filter("n1 IN ('function', 'async') OR logical"), F.lit("default"), F.lit("exports")))
    out = out.unionByName(pairs(single, F.col("member"), F.when(F.col("simple") & ~F.col("logical"), F.col("n1")).otherwise(F.col("member"))))
    listed = whole.filter("n1 = '{'").select("file_id", F.col("n1_pos").alias("par")).join(large(_parts(t.filter(_OBJECT))), ["file_id", "par"])
    key = F.regexp_extract(F.get("tokens", F.lit(0))["t"], rf"^({NAME})\z", 1)
    value = F.when((F.size("tokens") == 3) & (F.get("tokens", F.lit(1))["t"] == ":") & (F.get("tokens", F.lit(2))["k"] == "id"), F.get("tokens", F.lit(2))["t"])
    return out.unionByName(pairs(listed.filter(key != ""), key, F.coalesce(value, key)))


def exports_of(lexed: Lexed) -> DataFrame:
    """Exports with the first function of that name in the file; names bound to no function drop out."""
    first = _all_functions(lexed).filter("name IS NOT NULL").groupBy("file_id", F.col("name").alias("local")).agg(F.min(F.struct("line", "col")).alias("fn"))
    return _export_names(lexed).distinct().join(large(first), ["file_id", "local"]).select("file_id", "export_name", place_id(F.col("file_id"), F.col("fn")).alias("fn_id"))
