"""Functions of whole files, found where their tokens are cut: one row per function, without a stored token table.

The rules are those of ``facts._function_spans`` and of the joins behind it; what they look up by a token's place is a
row number here. Parameters leave as tokens, so that the same expressions name them. Files come one by one, so rows of a
file that repeats its id are not told apart: such files are left to the joins.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ramparts.operators import tokens as tok
from ramparts.session import bounded_batches

NOT_METHODS = ["if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "super", "import", "async", "with", "else", "do", "new"]
_RESULT_BEFORE = {":", "|", "&", "<", ",", "."}
_NOT_BEFORE_METHOD = {"function", "new", ".", "?.", "=", "return", "await"}
_OP, _ID, _STRING = 0, 1, 2
_SHAPE = ("start int, `end` int, end_line int, end_off int, line int, col int, start_off int, kind string, name string, is_async boolean, params_at int, up string, up_prev1 string, "
          "up_prev2 string, up_chain int, prev1 string, parts array<struct<tokens: array<struct<pos: int, t: string, k: string>>, inner: string>>, single string, asked boolean, src string")
_TYPES = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_FIELDS = [("start", "int"), ("end", "int"), ("end_line", "int"), ("end_off", "int"), ("line", "int"), ("col", "int"), ("start_off", "int"), ("kind", "string"), ("name", "string"),
           ("is_async", "boolean"), ("params_at", "int"), ("up", "string"), ("up_prev1", "string"), ("up_prev2", "string"), ("up_chain", "int"), ("prev1", "string")]


def _begins_name(text: str | None) -> bool:
    return bool(text) and (text[0] in "_$" or text[0].isascii() and text[0].isalpha())


def _functions(read: SimpleNamespace, codes: list[str]) -> Iterator[tuple]:
    """(row of the file, the fields, tokens of each parameter and what its first bracket holds, single parameter, asked, text) of every function."""
    n = len(read.file)
    if not n:
        return
    t, kind, near = read.t.to_pylist(), read.kind, read.near
    l1, n1, n2, following, parent, smin, chain = (near[x] for x in ("l1", "n1", "n2", "next", "par", "smin", "chain"))
    linked, logical = read.flags["linked"], read.flags["logical"]

    def is_text(word: str) -> np.ndarray:
        return pc.equal(read.t, word).to_numpy(zero_copy_only=False)

    def at(mask: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there >= 0, mask[there], False)
    op, name = kind == _OP, kind == _ID
    bracket, arrow, brace, colon = is_text("("), is_text("=>"), is_text("{"), is_text(":")
    before_arrow = at(arrow, following)
    anchor = bracket & op | name & before_arrow
    gives = at(colon | is_text("="), n1)
    keyword = is_text("function")
    places = bracket | keyword | is_text("async") | before_arrow | name & gives | at(brace, parent) & (smin == np.arange(n))
    in_order = np.argsort(parent, kind="stable")
    sorted_parents = parent[in_order]
    called = bracket & op & at(name, l1) & at(brace, parent) & (at(brace, n2) | at(colon, n2) & ~logical)

    anchors, calls, keywords, arrows, brackets = anchor.tolist(), np.flatnonzero(called).tolist(), np.flatnonzero(keyword & name & ~linked), np.flatnonzero(arrow & op), bracket & op
    if not (len(calls) or len(keywords) or len(arrows)):
        return
    # from here on single rows are looked at, for which lists are faster
    heads = np.flatnonzero(at(name, chain) & name).tolist()
    l1, l2, n1, n2, n3, parent, last, smin, chain, typed, prev1, prev2, up_chain = (
        near[x].tolist() for x in ("l1", "l2", "n1", "n2", "n3", "par", "last", "smin", "chain", "typed", "prev1", "prev2", "up_chain"))
    pos, line, col, begin, end = (read.places[x].tolist() for x in ("pos", "line", "col", "start", "end"))
    kind, places, files, order = kind.tolist(), places.tolist(), read.file.tolist(), in_order.tolist()

    def text(row: int) -> str | None:
        return t[row] if row >= 0 else None

    def place(row: int) -> int | None:
        return pos[row] if row >= 0 else None

    def ended(row: int) -> tuple[int | None, int | None, int | None]:
        return (pos[row], line[row], end[row]) if row >= 0 else (None, None, None)
    # (kind, own name, word, the two tokens before, anchor, end, first token of the part)
    found = []
    for i in keywords.tolist():
        a = n1[i] if text(n1[i]) == "(" else n2[i] if text(n2[i]) == "(" else n3[i]
        if a >= 0 and anchors[a]:
            one, two = text(n1[i]), text(n2[i])
            own = one if _begins_name(one) else two if one == "*" and two != "(" else None
            found.append(("function", own, i, l1[i], l2[i], a, n3[a] if text(n2[a]) == "{" else last[a], -1))
    # anchors by the part they stand in, for arrows with a result type
    in_part = None
    for i in arrows.tolist():
        e = n2[i] if text(n1[i]) == "{" else last[i]
        before = text(l1[i])
        typed_result = text(l2[i]) in _RESULT_BEFORE or before in (">", "]", "}") or l1[i] >= 0 and kind[l1[i]] == _STRING
        a = l2[i] if before == ")" else l1[i] if not typed_result and l1[i] >= 0 and kind[l1[i]] == _ID else -1
        if a < 0:
            if in_part is None:
                in_part = {}
                for b in np.flatnonzero(brackets).tolist():
                    in_part.setdefault((parent[b], smin[b]), []).append(b)
            there = in_part.get((parent[i], smin[i]), [])
            until = bisect_left(there, i)
            a = there[until - 1] if until else -1
        if a >= 0 and anchors[a]:
            found.append(("arrow", None, a, l1[a], l2[a], a, e, -1))
    for i in calls:
        own, before = t[l1[i]], text(l2[i])
        if own in NOT_METHODS or before in _NOT_BEFORE_METHOD or before == "*" and text(near["prev3"][i]) == "function":
            continue
        found.append(("method", own, l1[i], l2[i], -1, i, n3[i] if text(n2[i]) == "{" else last[i], smin[i]))
    if not found:
        return
    def inside(rows: list[int]) -> list[list[int]]:
        """What stands in each of some brackets, in order."""
        bounds = zip(np.searchsorted(sorted_parents, rows).tolist(), np.searchsorted(sorted_parents, rows, "right").tolist(), strict=True)
        return [order[a:b] for a, b in bounds]
    given_to = inside([f[5] for f in found])
    asked = {chain[i] for i in heads if t[i] == "input" or t[i].lower().endswith("procedure")}
    for (what, own, word, b1, b2, a, e, from_part), content in zip(found, given_to, strict=True):
        is_async = text(b1) == "async"
        by = -1 if what == "method" else b2 if is_async else b1
        given = -1
        if by >= 0 and t[by] in ("=", ":") and kind[by] == _OP:
            by_type = typed[by]
            if t[by] != ":" and by_type >= 0 and pos[by_type] - pos[smin[by]] <= 2 and l1[by] >= 0 and by_type != l1[by]:
                given = by_type
            elif l1[by] >= 0 and kind[l1[by]] == _ID:
                given = l1[by]
        start = given if given >= 0 else from_part if what == "method" else b1 if is_async else word
        if start < 0 or not places[start]:
            continue
        up = parent[start]
        fields = (pos[start], *ended(e), line[start], col[start], begin[start], what, t[given] if given >= 0 else own, is_async, pos[a], text(up),
                  text(prev1[up]) if up >= 0 else None, text(prev2[up]) if up >= 0 else None, place(up_chain[start]), text(prev1[start]))
        parts = []
        if t[a] == "(" and kind[a] == _OP:
            part = None
            for i in content:
                if kind[i] == _OP and t[i] in (",", ";"):
                    continue
                if part is None or smin[i] != part:
                    part = smin[i]
                    parts.append([[], None])
                if t[i] in ("{", "[") and parts[-1][1] is None:
                    parts[-1][1] = " ".join(t[j] for j in inside([i])[0])
                parts[-1][0].append(i)
        f = files[a]
        code, begun, done = codes[f], fields[6], fields[3]
        src = None if done is None else code[begun:done] if done > begun else ""
        yield f, fields, parts, t[a] if kind[a] == _ID else None, up_chain[start] in asked, src


def _function_rows(batches: Iterator[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    def lists(values: pa.Array, sizes: list[int]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), values)
    for some, tokens in tok.whole_files(batches):
        read = tok.annotated(tokens)
        rows = list(_functions(read, some["code"].to_pylist()))
        if not rows:
            continue
        files = pa.array([r[0] for r in rows], pa.int64())
        made = {c: some[c].take(files) for c in keep}
        for i, (field, shape) in enumerate(_FIELDS):
            made[field] = pa.array([r[1][i] for r in rows], _TYPES[shape])
        parts = [p for r in rows for p in r[2]]
        at = pa.array([i for p in parts for i in p[0]], pa.int64())
        part_tokens = pa.StructArray.from_arrays([read.column(c).take(at) for c in ("pos", "t", "k")], ["pos", "t", "k"])
        part = pa.StructArray.from_arrays([lists(part_tokens, [len(p[0]) for p in parts]), pa.array([p[1] for p in parts], pa.string())], ["tokens", "inner"])
        made |= {"parts": lists(part, [len(r[2]) for r in rows]), "single": pa.array([r[3] for r in rows], pa.string()), "asked": pa.array([r[4] for r in rows], pa.bool_()),
                 "src": pa.array([r[5] for r in rows], pa.string())}
        yield pa.RecordBatch.from_pydict(made)


def function_rows(files: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per function of ``files`` (``keep``, code): its span, name, place and text, and its parameters as tokens."""
    bounded_batches(files.sparkSession)
    shown = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    cut = files.select(*keep, "code", tok.token_array().alias("raw"))
    return cut.mapInArrow(lambda batches: _function_rows(batches, keep), f"{shown}, {_SHAPE}")
