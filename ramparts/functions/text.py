"""String and regex expressions shared by all rules.

The patterns are written for ASCII word edges and for the wide JavaScript notion of white space,
because Java's ``\\b`` and ``\\s`` differ from both on multilingual text.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "0-9A-Za-z_"
NOT_AFTER_WORD = f"(?<![{WORD}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"
# true exactly where an ASCII word character meets anything else
EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"
BLANK = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WS = f"[{BLANK}]"
NOT_WS = f"[^{BLANK}]"
DOT = r"[^\n\r\u2028\u2029]"


def per_application(build):
    """Build an expression once per application: large ones take many calls into the JVM."""
    built: dict[str, object] = {}

    @functools.wraps(build)
    def cached():
        app = SparkContext.getOrCreate().applicationId
        if app not in built:
            built[app] = build()
        return built[app]
    return cached


def explode_once(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element, evaluating a costly array once.

    A plain explode makes the optimizer test the array for emptiness in a filter of its own, which
    computes it again; the outer form has no such filter, and its empty rows are dropped here.
    """
    if pos is None:
        return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``; keeps large expressions small."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def redact(secret: Column) -> Column:
    """Keep the first six and last two characters of anything longer than twelve."""
    return F.when(F.length(secret) > 12, F.concat(F.left(secret, F.lit(6)), F.lit("…"), F.right(secret, F.lit(2)))
                  ).otherwise(secret)


def utf16_at_most(text: Column, cap: int) -> Column:
    """Length test in UTF-16 units; short texts are decided without encoding them."""
    return (F.length(text) <= cap // 2) | (
        (F.length(text) <= cap) & (F.octet_length(F.encode(text, "UTF-16BE")) <= 2 * cap))


def line_span(text: Column, first: Column, last: Column) -> Column:
    """The full physical lines ``first`` to ``last`` (1-based) of a text."""
    return F.array_join(F.slice(F.split(text, "\n", -1), first, last - first + 1), "\n")


def located(text: Column, pattern: str, groups: dict[str, int]) -> Column:
    """Array of matches in one text, each with 1-based ``line`` and ``col``, the named groups, and
    ``lead``, the text between the match before and this one, from its last semicolon on.

    The pattern runs over the text once: every match is rewritten in place as a marked record that
    holds the match and its groups, and the marked text is then cut at the marks. Marks that the
    text itself contains count as blanks.
    """
    mark, field, end = "\u0001", "\u0002", "\u0003"
    marked_already = F.contains(text, F.lit(mark)) | F.contains(text, F.lit(field)) | F.contains(text, F.lit(end))
    plain = F.when(marked_already, F.translate(text, mark + field + end, "   ")).otherwise(text)
    record = mark + field.join(["$0", *[f"${g}" for g in groups.values()]]) + end
    item = "".join(f", {n}: string" for n in groups)
    shape = f"array<struct<line: int, col: int, lead: string, hit: string{item}>>"

    def moved(line: Column, col: Column, passed: Column) -> tuple[Column, Column]:
        turns = F.length(passed) - F.length(F.replace(passed, F.lit("\n"), F.lit("")))
        return ((line + turns).cast("int"),
                F.when(turns > 0, F.length(F.substring_index(passed, "\n", -1)) + 1).otherwise(col + F.length(passed)).cast("int"))

    def step(acc: Column, part: Column) -> Column:
        def advance(v: Column) -> Column:
            fields = v["fields"]
            line, col = moved(acc["line"], acc["col"], F.concat(fields[0], v["tail"]))
            found = F.struct(acc["line"].alias("line"), acc["col"].alias("col"), acc["lead"].alias("lead"), fields[0].alias("hit"),
                             *[fields[i + 1].alias(n) for i, n in enumerate(groups)])
            return F.struct(line.alias("line"), col.alias("col"), F.substring_index(v["tail"], ";", -1).alias("lead"),
                            F.concat(acc["out"], F.array(found)).alias("out"))
        return let(F.struct(F.split(F.substring_index(part, end, 1), field, -1).alias("fields"),
                            F.substring_index(part, end, -1).alias("tail")), advance)

    def walk(parts: Column) -> Column:
        line, col = moved(F.lit(1), F.lit(1), parts[0])
        start = F.struct(line.alias("line"), col.alias("col"), F.substring_index(parts[0], ";", -1).alias("lead"), F.array().cast(shape).alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step, lambda acc: acc["out"])

    return let(F.split(F.regexp_replace(plain, pattern, record), mark, -1), walk)


def match_evidence(df: DataFrame, text: str, pattern: str, keep: list[str], hint: str | None = None) -> DataFrame:
    """One row per match with its line, 1-based column and full physical line.

    Texts without a match are dropped before they are cut into lines, and each line is its own
    row before its matches are located, so the work stays linear in the text. The pattern must
    not reach over a line break. ``hint`` is a cheaper pattern that every match contains; it
    takes the place of the full one wherever whole texts are searched.
    """
    lines = explode_once(df.filter(matches(F.col(text), hint or pattern)), keep, F.split(text, "\n", -1), "evidence", "_no")
    if hint:
        lines = lines.filter(matches(F.col("evidence"), hint))
    kept = lines.filter(matches(F.col("evidence"), pattern))
    return (explode_once(kept, [*keep, (F.col("_no") + 1).cast("bigint").alias("line"), "evidence"], located(F.col("evidence"), pattern, {}), "_m")
            .select(*keep, "line", F.col("_m.col").cast("bigint").alias("col"), F.col("_m.hit").alias("match"), "evidence"))
