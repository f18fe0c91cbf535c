"""Repeated passages: suffixes ordered only through the threshold length, by most-significant-digit passes.

A byte is removed if a string of ``width`` bytes that covers it also starts in a document with a smaller id.
The suffixes in question are all places where ``width`` bytes fit; they are sorted by their first ``width``
bytes only, in passes over ever fewer of them. Equal groups of the last pass are the repeated strings.

1. First digit. A suffix's digit is the smallest hash of the ``digit`` -byte strings inside its ``width``
   bytes: equal suffixes have equal digits, and neighbours mostly share one, so a run of neighbours travels
   as one row (digit, hash of the run's bytes, document). A digit seen in one document only ends there: its
   suffixes are unique. A run seen whole in a smaller document is removed whole.
2. Second digit. Of the other runs, the smallest document's of each different run goes on if its digit has
   several. A suffix reaches at least half of its remaining bytes beyond one end of the digit's string, so
   a run ends here if no other run of its digit has the same bytes there, to the left or to the right.
3. Third digit. The remaining runs are opened: their suffixes go on as (digit, hash of the ``width`` bytes).
4. Groups equal in digit and hash are equal strings; all but their smallest document lose the bytes.

Digits and string hashes are two independent 64-bit polynomial hashes. Texts are read as UTF-8 bytes in
pieces of bounded size, so a text's length is no limit, and are shuffled twice, by id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches, slices, stored

WIDTH = 50
DIGIT = 20
PIECE = 1 << 18
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _tables(seed: int):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 64, 256, np.uint64), _U(int(rng.integers(1 << 40, 1 << 63)) * 2 + 1)


def _rolling(codes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Polynomial hash of every ``size`` -byte string, doubling the length step by step."""
    values, base = _tables(seed)
    power, length, out, done = values[codes], 1, None, 0
    factor = base
    while True:
        if size & length:
            if out is None:
                out, done = power, length
            else:
                n = min(len(out), len(power) - done)
                out, done = out[:n] * factor + power[done:done + n], done + length
        if done == size:
            return _mix(out)
        power = power[:-length] * factor + power[length:]
        length, factor = length * 2, _U(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)


def _sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    """Smallest of every ``span`` neighbours."""
    low, length = h, 1
    while length * 2 <= span:
        low, length = np.minimum(low[:-length], low[length:]), length * 2
    return np.minimum(low[:len(low) - (span - length)], low[span - length:]) if length < span else low


def _sides(codes, grams, at, count, value, width, digit) -> np.ndarray:
    """Two 32-bit hashes in one number: of the bytes left and right of the digit's string of each run.

    0 stands for a side that no suffix of the run reaches far enough. All bits set: the string is not at one
    certain place of the run, so the run has to be opened.
    """
    reach, span = (width - digit) // 2, width - digit + 1
    low, high = np.full(len(at), 1 << 60), np.full(len(at), -1)
    for base in (at, at + count - 1):
        for k in range(span):
            hit = grams[base + k] == value
            place = base[hit] + k
            low[hit], high[hit] = np.minimum(low[hit], place), np.maximum(high[hit], place)
    sure = (low == high) & (low >= at + count - 1) & (low < at + span)
    place = np.where(sure, low, at)
    out = np.zeros(len(at), np.uint64)
    values, base = _tables(3)
    for begin, reached in ((place - reach, place - reach >= at), (place + digit, place + digit + reach <= at + count - 1 + width)):
        first, h = np.where(reached, begin, 0), np.zeros(len(at), np.uint64)
        for k in range(reach):
            h = h * base + values[codes[np.minimum(first + k, len(codes) - 1)]]
        out = (out << _U(32)) | np.where(reached, (_mix(h) >> _U(32)) | _U(1), _U(0))
    return np.where(sure, out, ~_U(0))


class Runs:
    """Runs of one buffer: ``doc`` (index of the text), ``start`` (in the text), ``count``, ``digit``, ``content``, ``sides``."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]], width: int, digit: int):
        codes = np.concatenate([p for _, _, p in pieces])
        sizes = np.array([len(p) for _, _, p in pieces])
        grams = _rolling(codes, digit, 1)
        low = _sliding_min(grams, width - digit + 1)
        self.string = _rolling(codes, width, 2)
        ends = np.cumsum(sizes)
        piece = np.repeat(np.arange(len(pieces)), sizes)[:len(low)]
        valid = np.arange(len(low)) + width <= ends[piece]
        edge = np.r_[True, (low[1:] != low[:-1]) | (piece[1:] != piece[:-1])]
        first = np.flatnonzero(edge)
        # a run longer than a string is cut, so that its first and last string cover all of it
        away = np.arange(len(low)) - first[np.cumsum(edge) - 1]
        at = np.flatnonzero((edge | (away % width == 0)) & valid)
        where = np.flatnonzero(valid)
        count = np.diff(np.r_[np.searchsorted(where, at), len(where)])
        self.at, self.count, self.digit = at, count, low[at]
        self.content = _mix(self.string[at] * _U(3) + self.string[at + count - 1] * _U(0x9E3779B97F4A7C15) + count.astype(np.uint64))
        self.sides = _sides(codes, grams, at, count, self.digit, width, digit)
        self.doc = np.array([d for d, _, _ in pieces])[piece[at]]
        self.start = at - (ends - sizes)[piece[at]] + np.array([s for _, s, _ in pieces])[piece[at]]


def _buffers(texts, width: int):
    """Pieces of about ``PIECE`` bytes of several texts; a long text's pieces overlap by a string less a byte."""
    pieces, size = [], 0
    for i, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        for low in range(0, len(codes) - width + 1, PIECE):
            part = codes[low:low + PIECE + width - 1]
            pieces.append((i, low, part))
            size += len(part)
            if size >= PIECE:
                yield pieces
                pieces, size = [], 0
    if pieces:
        yield pieces


def _first_digits(width: int, digit: int):
    def step(batches):
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for pieces in _buffers(pdf["text"], width):
                runs = Runs(pieces, width, digit)
                one = np.unique(_salted(runs.content, runs.doc), return_index=True)[1]
                yield pd.DataFrame({"digit": runs.digit[one].view(np.int64), "content": runs.content[one].view(np.int64),
                                    "sides": runs.sides[one].view(np.int64), "id": ids[runs.doc[one]]})
    return step


def _salted(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return _mix(keys + _mix(doc.astype(np.uint64) + _U(1)))


def _spans(width: int, digit: int):
    """Rows (id, tie, text, whole, open) to (id, tie, removed spans, opened strings with their places)."""
    def lists(column, count):
        sizes = [0 if x is None else len(x) for x in column]
        flat = [np.asarray(x, np.int64) for x in column if x is not None and len(x)]
        return (np.concatenate(flat) if flat else np.zeros(0, np.int64)).view(np.uint64), np.repeat(np.arange(count), sizes)

    def step(batches):
        for pdf in (part for batch in batches for part in slices(batch, "text")):
            n = len(pdf)
            whole, opened = (_salted(*lists(pdf[c], n)) for c in ("whole", "open"))
            parts = {k: [] for k in ("doc", "low", "high", "odoc", "digit", "string", "place")}
            for pieces in _buffers(pdf["text"], width):
                runs = Runs(pieces, width, digit)
                key = _salted(runs.content, runs.doc)
                cut = np.isin(key, whole)
                parts["doc"].append(runs.doc[cut])
                parts["low"].append(runs.start[cut])
                parts["high"].append(runs.start[cut] + runs.count[cut] + width - 1)
                go = np.flatnonzero(np.isin(key, opened) & ~cut)
                each = runs.count[go]
                inner = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                parts["odoc"].append(np.repeat(runs.doc[go], each))
                parts["digit"].append(np.repeat(runs.digit[go], each))
                parts["string"].append(runs.string[np.repeat(runs.at[go], each) + inner])
                parts["place"].append(np.repeat(runs.start[go], each) + inner)
            joined = {k: np.concatenate([*v, np.zeros(0, np.int64 if k not in ("digit", "string") else np.uint64)]) for k, v in parts.items()}
            out = {"low": [], "high": [], "digit": [], "string": [], "place": []}
            for names, docs in ((("low", "high"), joined["doc"]), (("digit", "string", "place"), joined["odoc"])):
                cuts = np.searchsorted(docs, np.arange(n + 1))
                for k in names:
                    values = joined[k].view(np.int64)
                    out[k] = [values[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "tie": pdf["tie"].to_numpy(), **out})
    return step


def _resolve(width: int):
    """Rows (id, tie, low, high, string, place, hits) to (id, tie, low, high): strings found late become spans."""
    def step(batches):
        for pdf in batches:
            lows, highs = [], []
            for low, high, string, place, hits in zip(*(pdf[c] for c in ("low", "high", "string", "place", "hits"))):
                if hits is not None and len(hits):
                    at = np.sort(np.asarray(place, np.int64)[np.isin(np.asarray(string, np.int64), np.asarray(hits, np.int64))])
                    # places in a row become one span
                    cut = np.flatnonzero(np.diff(at) > 1)
                    low = np.concatenate([np.asarray(low, np.int64), at[np.r_[0, cut + 1]] if len(at) else at])
                    high = np.concatenate([np.asarray(high, np.int64), at[np.r_[cut, len(at) - 1]] + width if len(at) else at])
                lows.append(low)
                highs.append(high)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "tie": pdf["tie"].to_numpy(), "low": lows, "high": highs})
    return step


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (text, low, high) to the text's digest columns and the spans removed."""
    rows = []
    for text, low, high in zip(pdf["text"], pdf["low"], pdf["high"]):
        raw = (text or "").encode("utf-8", "surrogatepass")
        change = np.zeros(len(raw) + 1, np.int32)
        if low is not None and len(low):
            np.add.at(change, np.asarray(low, np.int64), 1)
            np.add.at(change, np.asarray(high, np.int64), -1)
        gone = np.cumsum(change[:-1]) > 0
        turns = np.diff(np.r_[False, gone, False].astype(np.int8))
        begin, end = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(begin) else raw
        rows.append((len(raw), int(gone.sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore" if len(begin) else "surrogatepass"),
                     begin.tolist(), end.tolist()))
    return pd.DataFrame({k: [r[i] for r in rows] for i, k in enumerate(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "begins", "ends"))})


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, digit: int = DIGIT,
                   columns: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_sha256"), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id (as ``id_col``), the wanted ``columns`` and the columns to ``carry`` along.

    ``columns`` are of n_bytes, n_removed, n_spans, kept_sha256, kept_text (what remains; a character cut in
    two loses its rest, whole characters stay), begins and ends (removed spans in bytes). Texts shorter than
    ``width`` bytes, null texts (empty) and rows without id keep everything; rows without id also remove
    nothing elsewhere. Rows of one id never remove each other; repeated rows give equal results. An empty
    table gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    source = source.withColumn("tie", F.xxhash64("text"))
    long = source.filter(F.col("id").isNotNull() & (F.octet_length("text") >= width)).select("id", "text")
    rows = long.mapInPandas(_first_digits(width, digit), "digit long, content long, sides long, id long")
    same, run = Window.partitionBy("digit"), Window.partitionBy("digit", "content")
    seen = (rows.withColumn("low_run", F.min("id").over(run)).withColumn("low_id", F.min("id").over(same)).withColumn("high_id", F.max("id").over(same))
            .withColumn("runs", F.min("content").over(same) != F.max("content").over(same)).filter("low_id < high_id AND (id > low_run OR runs)"))
    late_run = F.col("id") > F.col("low_run")
    seen = seen.select("digit", "id", F.when(late_run, F.col("content")).alias("whole"), F.when(~late_run, F.col("content")).alias("open"), "sides")
    # the second digit: rows of the smallest documents, counted by what stands left and right of the first
    left, right = F.shiftrightunsigned("sides", 32), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF))
    shared = [F.count("open").over(Window.partitionBy("digit", F.when(F.col("open").isNotNull() & (side != 0), side))) > 1 for side in (left, right)]
    unsure = F.max(F.when(F.col("open").isNotNull(), F.col("sides") == -1)).over(same)
    seen = seen.withColumn("go", unsure | ((left != 0) & shared[0]) | ((right != 0) & shared[1]))
    hits = seen.filter("whole IS NOT NULL OR go").select("id", "whole", "open")
    per_text = stored(hits.groupBy("id").agg(F.collect_set("whole").alias("whole"), F.collect_set("open").alias("open")), "runs")
    spans = stored(source.select("id", "tie", "text").join(per_text, "id")
                   .mapInPandas(_spans(width, digit), "id long, tie long, low array<long>, high array<long>, digit array<long>, string array<long>, place array<long>"), "spans")
    opened = spans.select("id", F.explode(F.arrays_zip("digit", "string")).alias("s")).select("id", "s.*")
    equal = Window.partitionBy("digit", "string")
    late = stored(opened.withColumn("low_id", F.min("id").over(equal)).filter("id > low_id").groupBy("id").agg(F.collect_set("string").alias("hits")), "late")
    spans = stored(spans.select("id", "tie", "low", "high", "string", "place").join(late, "id", "left")
                   .mapInPandas(_resolve(width), "id long, tie long, low array<long>, high array<long>"), "resolved").dropDuplicates(["id", "tie"])
    # repeated rows share their spans
    whole = source.join(spans, ["id", "tie"], "left")
    types = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept_text": "string", "begins": "array<long>", "ends": "array<long>"}
    kinds = dict(source.dtypes)
    carried = [f"_c{i}" for i in range(len(carry))]

    def finish(batches):
        for pdf in (part for batch in batches for part in slices(batch, "text")):
            out = _cut(pdf)
            yield pd.DataFrame({"id": pdf["id"], **{c: pdf[c] for c in carried}, **{c: out[c].to_numpy() for c in columns}})
    done = whole.mapInPandas(finish, ", ".join(["id long", *(f"{c} {kinds[c]}" for c in carried), *(f"{c} {types[c]}" for c in columns)]))
    return done.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias(id_col), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), *columns)
