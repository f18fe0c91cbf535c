"""Code as a token table: one row per token with its place, bracket depth, bracket partners and statement part.

A file's text is cut into tokens by one pattern in the JVM (comments and blanks belong to the token after them;
strings, templates and regex literals are single tokens, except that expressions inside templates become tokens of
their own between the template's parts). What depends on the order of tokens follows in the same task from running
sums over whole files: bracket depth, and since nothing else stands at an opening bracket's level before its partner,
the partner is simply the next token of that level. So nesting, argument lists, chains and functions have no bound of
their own, and neither indentation nor line breaks decide about blocks. Nothing is shuffled.

The running sums are numpy over Arrow batches. As window functions (the same rules, 8 windows and 5 sorts, the same
rows) they took almost three times as long, 15.5 against 5.8 seconds for 4 MB of code, and shuffled every token.

Levels: a bracket and its partner stand at the level of what surrounds them, their content one deeper. A *part*
(``seg``) is what stands between commas, semicolons or statement ends of one bracket. A *chain* is an operand with
its accesses, calls and indexes. A *region* is the innermost stretch that taint does not leave: an object, an
array, a block, or a part with a logical, conditional or arrow operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts.functions.text import per_application
from ramparts.session import bounded_batches, materialize

ID = r"[A-Za-z_$][0-9A-Za-z_$]*+"
TRIVIA = r"(?:\s++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z))*+"
STRING = r'"(?:[^"\\\n]++|\\[\s\S])*+(?:"|(?=\n)|\z)|' + r"'(?:[^'\\\n]++|\\[\s\S])*+(?:'|(?=\n)|\z)"
_PIECE = r"(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+"
_REGEX = r"(?:(?<=[=(,:;!&|?{\[])|(?<=[=(,:;!&|?{\[] )|(?<=return ))/(?![/*])(?:[^/\\\[\n]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/[A-Za-z]*+"
_NUMBER = r"[0-9](?:[0-9A-Za-z_]++|\.(?=[0-9]))*+"
_OPERATOR = (r">>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|[-+*/%&|^]=|\*\*|[\s\S]")
# templates inside template expressions, and braces inside them, are followed this deep
TEMPLATE_DEPTH = 4
_PART_MARK = "\u0001"  # put before later parts of a template, which look like code otherwise

OPENERS, CLOSERS = ["(", "[", "{"], [")", "]", "}"]
LOGICAL = ["||", "&&", "??", "?", "=>"]
ASSIGNMENTS = ["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "**=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="]
COMPARED = ["==", "===", "!=", "!=="]
KEYWORDS = ["await", "async", "true", "false", "null", "undefined", "typeof", "this", "new", "void", "delete", "function", "instanceof", "in", "of",
            "yield", "return", "const", "let", "var", "if", "else", "for", "while", "do", "switch", "case", "default", "break", "continue", "throw",
            "try", "catch", "finally", "class", "extends", "import", "export", "with", "super"]
_NOT_OPERANDS = ["await", "typeof", "new", "void", "delete", "function", "instanceof", "in", "of", "yield", "return", "const", "let", "var", "if", "else",
                 "for", "while", "do", "switch", "case", "throw", "try", "catch", "finally", "class", "extends", "import", "export", "with", "async"]
# a line that starts with one of these goes on with the statement before it
_GOES_ON = [".", "?.", "+", "-", "*", "/", "%", "=", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&&", "||", "??", "?", ":", "(", "[", ")", "]", "}",
            "{", ",", ";", "=>", "&", "|", "^", "**", "in", "instanceof", "of", "as", "from", "else", "catch", "finally", *ASSIGNMENTS[1:]]
_AFTER_BLOCK = ["else", "catch", "finally", "while", "from", "as", "of", "in", "instanceof", "satisfies"]


def _template(depth: int) -> str:
    return rf"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|\$\{{{_braced(depth)}\}})*+`"


def _braced(depth: int) -> str:
    inside = r"[^{}`'\"/]++|" + STRING + r"|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/|/"
    if depth:
        inside += rf"|{_template(depth - 1)}|\{{{_braced(depth - 1)}\}}"
    return f"(?:{inside})*+"


TOKEN = rf"{TRIVIA}(?:{STRING}|{_template(TEMPLATE_DEPTH)}|{_REGEX}|{ID}|{_NUMBER}|\z|{_OPERATOR})"
_TEMPLATE_CUT = (rf"\A{TRIVIA}`{_PIECE}(?:`|\$\{{)|(?<=\$\{{)(?!\}}){_braced(TEMPLATE_DEPTH)}|\}}|{_PIECE}(?:`|\$\{{)")


def _cut(text: Column, depth: int) -> Column:
    """The tokens of a text in order; joined (without the part marks) they are the text."""
    whole = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    if not depth:
        return whole

    def parts(token: Column) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all(token, F.lit(_TEMPLATE_CUT), F.lit(0)), lambda p, i: F.when(
            (i == 0) | (p == "}"), F.array(p)).when(p.rlike(rf"\A{_PIECE}(?:`|\$\{{)\z"), F.array(F.concat(F.lit(_PART_MARK), p))).otherwise(_cut(p, depth - 1))))
    with_expressions = F.contains(text, F.lit("`")) & F.contains(text, F.lit("${"))
    opened = F.transform(whole, lambda t: F.when(t.endswith("`") & F.contains(t, F.lit("${")), parts(t)).otherwise(F.array(t)))
    return F.when(with_expressions, F.flatten(opened)).otherwise(whole)


@per_application
def token_array() -> Column:
    return _cut(F.translate(F.col("code"), _PART_MARK, " "), TEMPLATE_DEPTH)


# blanks and comments before a token, as TRIVIA has them; Python's \\s knows more blanks than Java's
_LEAD = re.compile(r"(?:[ \t\n\x0b\f\r]++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z))*+")
_BLANKS = " \t\n\x0b\f\r"


def _texts(values: Sequence[str]) -> pa.Array:
    return pa.array(values, pa.string())


def _first_bytes(texts: pa.Array) -> np.ndarray:
    """The first byte of every text, 0 for empty ones."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    filled = ends[1:] > ends[:-1]
    return np.where(filled, data[np.where(filled, ends[:-1], 0)], 0) if len(data) else np.zeros(len(texts), np.uint8)


def _raw_tokens(raw: pa.Array, pos: np.ndarray) -> pa.Table:
    """Tokens with their kind, and the line breaks before and inside them, from what the pattern cut.

    Vectors over all tokens of a batch; only tokens behind a comment or a line break are looked at one by one.
    """
    def numbers(values: pa.Array) -> np.ndarray:
        return values.to_numpy(zero_copy_only=False)
    begun = _first_bytes(raw)
    marked = begun == ord(_PART_MARK)
    t = raw
    stripped = np.isin(begun, [ord(c) for c in _BLANKS + "/"]) | marked
    if stripped.any():
        at = np.flatnonzero(stripped)
        some = raw.take(pa.array(at))
        bare = pc.utf8_ltrim(some, _BLANKS)
        behind = np.flatnonzero(numbers(pc.or_(pc.starts_with(bare, "//"), pc.starts_with(bare, "/*"))))
        bare = bare.to_pylist()
        for i in behind:
            bare[i] = bare[i][_LEAD.match(bare[i]).end():]
        for i in np.flatnonzero(marked[at]):
            bare[i] = some[i].as_py()[1:]
        t = pc.replace_with_mask(raw, pa.array(stripped), _texts(bare))
    first = _first_bytes(t)
    long, t_long = numbers(pc.utf8_length(raw)).astype(np.int64), numbers(pc.utf8_length(t)).astype(np.int64)
    template = marked | (first == ord("`"))
    string = (first == ord('"')) | (first == ord("'"))
    name = (first >= ord("a")) & (first <= ord("z")) | (first >= ord("A")) & (first <= ord("Z")) | (first == ord("_")) | (first == ord("$"))
    digit = (first >= ord("0")) & (first <= ord("9"))
    kind = np.select([template, string, name, digit, (first == ord("/")) & (t_long > 2)], [5, 2, 1, 3, 4], 0)
    opens = np.isin(first, [ord(c) for c in OPENERS]) & (t_long == 1) | template & numbers(pc.ends_with(t, "${"))
    breaks = numbers(pc.count_substring(raw, "\n")).astype(np.int64)
    tail, lead_breaks, lead_tail = np.full(len(raw), -1), np.zeros(len(raw), np.int64), np.full(len(raw), -1)
    broken = np.flatnonzero(breaks)
    if len(broken):
        for i, text, lead in zip(broken, raw.take(pa.array(broken)).to_pylist(), (long - t_long)[broken], strict=True):
            tail[i] = len(text) - 1 - text.rfind("\n")
            lead_breaks[i] = text.count("\n", 0, lead)
            if lead_breaks[i]:
                lead_tail[i] = lead - 1 - text.rfind("\n", 0, lead)
    return pa.table({"pos": pos, "t": t, "k": pa.array(_KINDS).take(pa.array(kind)), "size": long - marked, "opens": opens, "breaks": breaks, "tail": tail,
                     "lead_breaks": lead_breaks, "lead_tail": lead_tail})


class _Rows:
    """Rows of whole groups in order, for running questions: the same as windows over (group, place)."""

    def __init__(self, *groups: np.ndarray):
        self.n = len(groups[0])
        self.at = np.arange(self.n)
        fresh = np.ones(self.n, bool)
        if self.n:
            fresh[1:] = np.logical_or.reduce([g[1:] != g[:-1] for g in groups])
        self.fresh = fresh
        self.begin = np.maximum.accumulate(np.where(fresh, self.at, 0)) if self.n else self.at

    def total(self, values: np.ndarray) -> np.ndarray:
        """Running sum, this row included."""
        sums = np.cumsum(values, dtype=np.int64)
        return sums - sums[self.begin] + values[self.begin] if self.n else sums

    def latest(self, holds: np.ndarray) -> np.ndarray:
        """Row of the latest place where something held, this one included; -1 for none in the group."""
        found = np.maximum.accumulate(np.where(holds, self.at, -1)) if self.n else self.at
        return np.where(found >= self.begin, found, -1)

    def near(self, steps: int) -> np.ndarray:
        """Row so many steps on (or back) in the group, else -1."""
        there = self.at + steps
        inside = (there >= 0) & (there < self.n)
        there = np.where(inside, there, 0)
        return np.where(inside & (self.begin[there] == self.begin) if self.n else inside, there, -1)


def _picked(column: pa.Array, rows: np.ndarray) -> pa.Array:
    """Values at ``rows``; -1 gives null."""
    return column.take(pa.array(rows, pa.int64(), mask=rows < 0))


_WORDS = sorted({*OPENERS, *CLOSERS, *LOGICAL, *ASSIGNMENTS, *_NOT_OPERANDS, *_GOES_ON, *_AFTER_BLOCK, "++", "--", ":", ".", "?."})
_KINDS = ["op", "id", "string", "number", "regex", "template"]


def annotated(rows: pa.Table) -> SimpleNamespace:
    """The tokens of whole files from their cut tokens in order: ``column(name)`` makes a column of the token table, ``file`` tells
    the file of a token, and ``near`` the rows of the tokens beside and around it, -1 for none."""
    def numbers(name: str, missing: int = -1) -> np.ndarray:
        return pc.fill_null(rows[name].combine_chunks(), missing).to_numpy(zero_copy_only=False).astype(np.int64)

    file, size, tail = numbers("file"), numbers("size"), numbers("tail")
    every = _Rows(file)
    end, above = every.total(size), every.total(numbers("breaks")) - numbers("breaks")
    broken = every.latest(tail >= 0)
    broken = np.where(every.fresh, -1, np.where(np.roll(broken, 1) >= every.begin, np.roll(broken, 1), -1)) if every.n else broken
    last_break = np.where(broken >= 0, end[broken] - tail[broken], 0)
    # blanks at the end of a template expression are counted, but are no token
    kept = pc.not_equal(rows["t"], "").to_numpy()
    rows, file, end = rows.filter(pa.array(kept)), file[kept], end[kept]
    t, k = rows["t"].combine_chunks(), rows["k"].combine_chunks()
    pos, lead_breaks, lead_tail = numbers("pos"), numbers("lead_breaks"), numbers("lead_tail")
    start = end - pc.utf8_length(t).to_numpy(zero_copy_only=False)
    line = above[kept] + lead_breaks + 1
    col = np.where(lead_tail >= 0, lead_tail + 1, start - last_break[kept] + 1)
    word = pc.fill_null(pc.index_in(t, value_set=pa.array(_WORDS)), -1).to_numpy(zero_copy_only=False)
    kind = pc.index_in(k, value_set=pa.array(_KINDS)).to_numpy(zero_copy_only=False)
    number = {w: i for i, w in enumerate(_WORDS)}
    op, name, template = kind == 0, kind == 1, kind == 5

    def among(values: np.ndarray, words: list[str]) -> np.ndarray:
        return np.isin(values, [number[w] for w in words])

    def back(values: np.ndarray, there: np.ndarray, none: int = -1) -> np.ndarray:
        return np.where(there >= 0, values[there], none)
    opens = rows["opens"].to_numpy()
    closes = op & among(word, CLOSERS)
    starts_template = pc.starts_with(t, "`").to_numpy(zero_copy_only=False)
    ends_template = template & pc.ends_with(t, "`").to_numpy(zero_copy_only=False)

    files = _Rows(file)
    lvl = files.total(opens.astype(np.int64) - closes) - opens
    p1, p2, p3, following = files.near(-1), files.near(-2), files.near(-3), files.near(1)
    after_open = np.where(p1 >= 0, opens[p1], True)
    # a partner that follows at once closes an empty bracket
    first = after_open & ~closes
    joined = among(back(word, p1), [".", "?."]) & (back(kind, p2) == 1)
    run = files.latest(name & ~joined)

    # the tokens of one level side by side
    order = np.lexsort((lvl, file))
    level = _Rows(file[order], lvl[order])

    def in_level(there: np.ndarray) -> np.ndarray:
        """Rows of the level's order as rows of the file's order, for every row of the file."""
        out = np.empty(level.n, np.int64)
        out[order] = np.where(there >= 0, order[there], -1)
        return out
    group = in_level(level.latest(first[order]))
    parent = np.where(group >= 0, p1[group], -1)
    # neighbours in other brackets of the same level are none
    entered_at = level.latest(first[order])
    steps = {}
    for n in (-1, -2, 1, 2, 3):
        there = level.near(n)
        steps[n] = in_level(np.where((there >= 0) & (entered_at[there] == entered_at), there, -1))
    l1, l2, n1, n2, n3 = (steps[n] for n in (-1, -2, 1, 2, 3))
    w1, k1 = back(word, l1), back(kind, l1)
    up = np.where(parent >= 0, word[parent], -1)
    in_block = (parent < 0) | (up == number["{"])
    closed = (k1 == 0) & among(w1, CLOSERS)
    operand_end = (l1 >= 0) & ((k1 >= 2) & (k1 <= 4) | (k1 == 1) & ~among(w1, _NOT_OPERANDS) | closed | (k1 == 5) & np.where(l1 >= 0, ends_template[l1], False))
    later_part = template & (w1 == number["}"]) & ~starts_template
    ends_line = (lead_breaks > 0) & (operand_end | among(w1, ["++", "--"])) & ~(among(word, _GOES_ON) & (kind <= 1)) & ~later_part
    after_block = (w1 == number["}"]) & (k1 == 0) & name & ~among(word, _AFTER_BLOCK)
    starts = first | ((k1 == 0) & among(w1, [",", ";"])) | (in_block & (ends_line | after_block))
    starts[order[level.fresh]] = True
    dot = op & among(word, [".", "?."])
    applied = op & among(word, ["(", "["]) & operand_end
    linked = ~starts & (dot | name & (k1 == 0) & among(w1, [".", "?."]) | applied | closes | later_part)
    chain = in_level(level.latest(~linked[order]))
    # the first bracket that calls in a chain, at the chain's head
    begins, called = np.flatnonzero(~linked[order]), np.full(level.n, -1)
    if level.n:
        none = np.iinfo(np.int64).max
        least = np.minimum.reduceat(np.where((op & (word == number["("]))[order], pos[order], none), begins)
        called[order[begins]] = np.where(least < none, least, -1)
    begun = level.latest(starts[order])
    seg = np.empty(level.n, np.int64)
    seg[order] = level.total(starts[order].astype(np.int64))
    part = np.cumsum(starts[order]) - 1
    heads = np.flatnonzero(starts[order])
    deciding = (op & among(word, LOGICAL))[order]
    logical, last = np.empty(level.n, bool), np.empty(level.n, np.int64)
    if level.n:
        logical[order] = np.logical_or.reduceat(deciding, heads)[part]
        last[order] = order[np.append(heads[1:], level.n)[part] - 1]
    colon = level.latest((op & (word == number[":"]) & (k1 == 1))[order])
    typed = in_level(np.where(colon >= begun, colon, -1))
    typed = np.where(typed >= 0, l1[typed], -1)
    smin = in_level(begun)

    def regions() -> tuple[np.ndarray, np.ndarray]:
        """A running count of stretches that taint does not leave, and the place of the one around each token."""
        here = files.at
        opened = (here == smin) & logical
        entered = after_open & (p1 >= 0) & among(back(word, p1), ["[", "{"]) & (back(kind, p1) == 0)
        left = op & ((word == number["]"]) | (word == number["}"]) & ~((l1 >= 0) & (k1 == 5)))
        ended = (here == last) & logical
        ended_before = np.where(p1 >= 0, ended[p1], False)
        inside = files.total(opened.astype(np.int64) + entered - left - ended_before)
        by_depth = np.lexsort((inside, file))
        depth = _Rows(file[by_depth], inside[by_depth])
        found = depth.latest((opened | entered | (starts & in_block))[by_depth])
        region = np.empty(depth.n, np.int64)
        region[by_depth] = np.where(found >= 0, by_depth[found], -1)
        return inside, np.where(region >= 0, pos[region] if level.n else region, -1)

    def whole(values: np.ndarray, there: np.ndarray) -> pa.Array:
        return pa.array(values[there] if level.n else values, pa.int32(), mask=there < 0)
    up_chain, l1_chain = back(chain, parent), back(chain, l1)
    places = {"pos": pos, "line": line, "col": col, "start": start, "end": end, "lvl": lvl, "seg": seg,
              "par": np.where(parent >= 0, pos[parent], -1) if level.n else pos}
    # chains that a comparison has on its sides
    compared = np.flatnonzero(op & among(word, COMPARED))
    beside = np.zeros(level.n + 1, bool)
    beside[np.append(l1_chain[compared], n1[compared])] = True
    flags = {"opens": opens, "linked": linked, "logical": logical, "beside": beside[chain] & (chain >= 0)}
    texts = {"up": parent, "up_prev1": back(p1, parent), "up_prev2": back(p2, parent), "up_up": back(parent, parent), "up_n2": back(n2, parent), "chain_t": chain,
             "chain_before": back(l1, chain), "run_t": run, "run_before": back(p1, run), "prev1": p1, "prev2": p2, "prev3": p3, "next": following, "l1": l1, "l2": l2,
             "n1": n1, "n2": n2, "typed": typed}
    kinds = {"chain_k": chain, "l1_k": l1, "l2_k": l2}
    at = {"up_chain": (pos, up_chain), "smin": (pos, smin), "last": (pos, last), "last_line": (line, last), "last_end": (end, last), "chain": (pos, chain),
          "chain_line": (line, chain), "chain_col": (col, chain), "run": (pos, run), "run_line": (line, run), "run_col": (col, run), "l1_pos": (pos, l1),
          "l1_chain": (pos, l1_chain), "l2_pos": (pos, l2), "n1_pos": (pos, n1), "n2_pos": (pos, n2), "n3_pos": (pos, n3), "n1_line": (line, n1), "n2_line": (line, n2),
          "n3_line": (line, n3), "n1_end": (end, n1), "n2_end": (end, n2), "n3_end": (end, n3), "typed_pos": (pos, typed), "typed_line": (line, typed), "typed_col": (col, typed)}

    def column(name: str) -> pa.Array:
        if name in ("inside", "region"):
            if name not in places:
                places["inside"], places["region"] = regions()
            return pa.array(places[name], pa.int32())
        if name in ("t", "k"):
            return t if name == "t" else k
        if name in texts or name in kinds:
            return _picked(t, texts[name]) if name in texts else _picked(k, kinds[name])
        if name in at:
            return whole(*at[name])
        if name == "chain_call":
            return pa.array(called, pa.int32(), mask=called < 0)
        return pa.array(flags[name]) if name in flags else pa.array(places[name], pa.int32())
    near = {"l1": l1, "l2": l2, "n1": n1, "n2": n2, "n3": n3, "next": following, "prev1": p1, "prev2": p2, "prev3": p3, "par": parent, "up_chain": up_chain, "chain": chain,
            "smin": smin, "last": last, "typed": typed}
    return SimpleNamespace(file=file, t=t, kind=kind, near=near, places=places, flags=flags, column=column)


_TEXTS = ["t", "k", "up", "up_prev1", "up_prev2", "chain_t", "chain_k", "chain_before", "run_t", "run_before", "up_up", "up_n2", "prev1", "prev2", "prev3", "next", "l1", "l1_k", "l2", "l2_k",
          "n1", "n2", "typed"]
_FLAGS = ["opens", "linked", "logical", "beside"]
_SHOWN = ["pos", "t", "k", "line", "col", "start", "end", "lvl", "opens", "linked", "par", "up", "up_prev1", "up_prev2", "up_up", "up_n2", "up_chain", "seg", "smin", "last", "last_line",
          "last_end", "logical", "chain", "chain_t", "chain_k", "chain_line", "chain_col", "chain_before", "chain_call", "run", "run_t", "run_line", "run_col", "run_before", "prev1", "prev2",
          "prev3", "next", "l1", "l1_k", "l1_pos", "l1_chain", "l2", "l2_k", "l2_pos", "n1", "n1_pos", "n2", "n2_pos", "n3_pos", "n1_line", "n2_line", "n3_line", "n1_end", "n2_end",
          "n3_end", "typed", "typed_pos", "typed_line", "typed_col", "inside", "region", "beside"]


# files are annotated together up to so many tokens; a longer file alone
_TOGETHER = 100_000


def whole_files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
    """Some rows of whole files at a time, with their tokens; ``file`` is a token's row."""
    for batch in batches:
        counts = pc.fill_null(pc.list_value_length(batch["raw"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        begin = 0
        while begin < len(counts):
            done = ends[begin - 1] if begin else 0
            until = max(begin + 1, int(np.searchsorted(ends, done + _TOGETHER, "right")))
            some, n = batch.slice(begin, until - begin), counts[begin:until]
            begin = until
            if n.sum():
                row = np.repeat(np.arange(len(n)), n)
                tokens = _raw_tokens(some["raw"].flatten(), np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                yield some, tokens.append_column("file", pa.array(row))


def _stored_rows(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    for some, tokens in whole_files(batches):
        read = annotated(tokens)
        shown = {"file_id": some["file_id"].take(pa.array(read.file)), **{name: read.column(name) for name in columns}}
        yield pa.RecordBatch.from_pydict(shown)


def token_table(files: DataFrame, columns: Sequence[str] = _SHOWN) -> DataFrame:
    """Tokens of ``files`` (file_id, code), unwritten, with the ``columns`` that the facts to be read need.

    ``l1, l2`` and ``n1, n2, n3`` are the tokens before and after at the same level of the same bracket, ``prev1`` to
    ``prev3`` and ``next`` those of the text; ``par`` and ``up`` the place and text of the bracket around, ``up_up`` the
    text of the one around that, ``up_n2`` what follows the bracket's end, ``last`` the end of the part, ``typed`` the
    latest ``name :`` of the part, ``beside`` whether the chain is a side of a comparison, ``run`` the start of the latest dotted name, ``chain_call`` a head's first call.
    """
    columns = [c for c in _SHOWN if c in columns]
    bounded_batches(files.sparkSession)
    shape = f"file_id {files.schema['file_id'].dataType.simpleString()}, " + ", ".join(
        f"`{c}` {'string' if c in _TEXTS else 'boolean' if c in _FLAGS else 'int'}" for c in columns)
    return files.select("file_id", token_array().alias("raw")).mapInArrow(lambda batches: _stored_rows(batches, columns), shape)


def stored_tokens(files: DataFrame, columns: Sequence[str] = _SHOWN, wanted: str | None = None) -> DataFrame:
    """The token table, written once for all the facts that are read from it: its ``columns`` and rows that they need."""
    table = token_table(files, columns)
    return materialize(table.filter(wanted) if wanted else table, "tokens")
