"""Encoding and decoding with a SentencePiece model of the merge (BPE) type, without running its merges.

Method: a merge encoder gives every prefix of a text exactly one last token. An automaton over all
pieces tells, for each position, which pieces end there; the one whose neighbour before it (the
last token of the shorter prefix, already known) is *compatible* is the prefix's last token. Two
tokens are compatible if no merge across their border would have come before the merges that made
them. The table takes one step per position, and the ids are read from it backwards.

Texts are cut where no piece can reach across (between characters that no piece has side by side), and the tokens of short chunks are remembered in the worker, up to a fixed number of them.

Defined results: a null or empty text has no ids and decodes to the empty text; characters outside
the vocabulary become byte tokens; texts of any length are encoded whole; repeated rows and null
ids stay rows of their own; an empty table gives an empty result; further columns stay as they are,
but a column that has the name of the result is replaced.

The vocabulary is bounded by the model (32,000 pieces here) and is broadcast; documents never meet
the driver. Nothing is shuffled, so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches

MARK = "▁"  # stands for a space inside pieces
LATEST = 1 << 60  # the rank of a merge that never comes
REMEMBERED, LONGEST_REMEMBERED = 400_000, 48
LENGTH_BITS = 8
LENGTH = (1 << LENGTH_BITS) - 1
PAIR_BITS = 28


def merge_steps(text: str, rank: dict[str, int]) -> tuple[list[str], dict[str, tuple[str, str]]]:
    """The tokens of a short text by plain merging, best rank first and leftmost among equals, and the parts of each merge."""
    parts, made = list(text), {}
    while True:
        best, at = min(((rank.get(a + b, LATEST), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(LATEST, 0))
        if best == LATEST:
            return parts, made
        made[parts[at] + parts[at + 1]] = (parts[at], parts[at + 1])
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


def _edge(text: str, rank: dict[str, int], side: int) -> list[tuple[str, int]]:
    """The tokens that form one edge of a token, smallest first, each with the rank of the merge that takes it up."""
    made, edge, above = merge_steps(text, rank)[1], [], LATEST
    while True:
        edge.append((text, above))
        if text not in made:
            return edge[::-1]
        above, text = rank[text], made[text][side]


def load_model(path: str) -> dict:
    """What executors need of a model: pieces, ids of bytes, and the two edges of every piece that can be an output."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, train = model.normalizer_spec, model.trainer_spec
    plain = not rules.precompiled_charsmap and not rules.normalization_rule_tsv and rules.escape_whitespaces and not rules.remove_extra_whitespaces
    if train.model_type != train.BPE or not train.byte_fallback or not plain or train.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: only merge models with byte fallback that leave texts as they are")
    if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: pieces outside the merges are not supported")
    normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
    scores = {s: n for n, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
    rank = {text: scores[s] for text, (_, s) in normal.items()}
    if max(map(len, normal)) > LENGTH or len(model.pieces) >= 1 << PAIR_BITS - LENGTH_BITS:
        raise ValueError(f"{path}: pieces or vocabulary too long for the table's entries")
    if any(c not in normal for text in normal for c in text):
        raise ValueError(f"{path}: a character stands in pieces but is none itself")
    reached = [text for text in normal if merge_steps(text, rank)[0] == [text]]
    return {
        "pieces": [p.piece for p in model.pieces],
        "silent": [i for i, p in enumerate(model.pieces) if p.type == p.CONTROL],
        "unknown": {i: train.unk_surface for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN},
        "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE},
        "prefix": rules.add_dummy_prefix,
        "rank": rank,
        "ids": {text: normal[text][0] for text in reached},
        "right_edge": {normal[t][0]: _edge(t, rank, 1) for t in reached},
        "left_edge": {normal[t][0]: _edge(t, rank, 0) for t in reached},
        "chunk": chunk_pattern(normal),
    }


def chunk_pattern(pieces) -> str:
    """A pattern that cuts texts only between characters that are side by side in no piece.

    Marks and letters stay together with what may join them: marks before a letter, and after a letter those
    characters (with what follows them up to the next letter) that some piece has behind that letter.
    """
    pairs = {pair for text in pieces for pair in zip(text, text[1:])}
    signs = {c for text in pieces for c in text} - {MARK}
    letters = {c for c in signs if c.isalpha()}

    def any_of(chars) -> str:
        return "[" + "".join(map(re.escape, sorted(chars))) + "]"
    if any(b == MARK and a != MARK or b in letters and a not in letters and a != MARK for a, b in pairs) or not letters or letters == signs:
        return r"[\s\S]+"
    other = any_of(signs - letters)
    behind: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        if a in letters and b not in letters:
            behind.setdefault(b, []).append(a)
    joined = "|".join(f"(?<={any_of(a)}){re.escape(b)}{other}*" for b, a in behind.items())
    # a character outside the vocabulary stands alone
    return rf"{MARK}*{any_of(letters)}+{f'(?:{joined})?' if joined else ''}|{MARK}*{other}+|{MARK}+|[\s\S]"


class Encoder:
    """The automaton, the compatibility test and the prefix table over one loaded model."""

    def __init__(self, model: dict):
        import ahocorasick

        self.model, self.rank = model, model["rank"]
        self.automaton = ahocorasick.Automaton()
        for text, i in model["ids"].items():
            self.automaton.add_word(text, i << LENGTH_BITS | len(text))
        self.automaton.make_automaton()
        self.chunk = re.compile(model["chunk"])
        self.known_pairs: dict[int, bool] = {}
        # the ids of short chunks met lately, as bytes
        self.remembered = lru_cache(REMEMBERED)(self._chunk_ids)

    def compatible(self, first: int, second: int) -> bool:
        """No merge across the border comes before the border tokens are taken up by their own sides."""
        left, right = self.model["right_edge"][first], self.model["left_edge"][second]
        i = j = 0
        while True:
            (a, up_left), (b, up_right) = left[i], right[j]
            across = self.rank.get(a + b, LATEST)
            # among equal ranks the leftmost merge comes first
            if across < up_left and across <= up_right and across < LATEST:
                return False
            if up_left == up_right == LATEST:
                return True
            if up_left <= up_right:
                i += 1
            else:
                j += 1

    def _chunk_ids(self, chunk: str) -> bytes:
        # an entry is a token and its length in one number, 0 where no piece ends
        last, pairs = [0] * (len(chunk) + 1), self.known_pairs
        known = pairs.get
        if len(pairs) > REMEMBERED:
            pairs.clear()
        for end, entry in self.automaton.iter(chunk):
            end += 1
            if not last[end]:
                size = entry & LENGTH
                before = last[end - size] if end > size else 0
                # an unknown character before a token keeps it apart, as the start of the text does
                if before:
                    pair = before << PAIR_BITS | entry
                    fits = known(pair)
                    if fits is None:
                        fits = pairs[pair] = self.compatible(before >> LENGTH_BITS, entry >> LENGTH_BITS)
                    if not fits:
                        continue
                last[end] = entry
        ids, at = [], len(chunk)
        while at:
            entry = last[at]
            if entry:
                ids.append(entry >> LENGTH_BITS)
                at -= entry & LENGTH
            else:
                at -= 1
                ids.extend(self.model["bytes"][b] for b in reversed(chunk[at].encode()))
        ids.reverse()
        return array("i", ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a text, 4 bytes each."""
        if not text:
            return b""
        spaced = text.replace(" ", MARK)
        chunks = self.chunk.findall(MARK + spaced if self.model["prefix"] else spaced)
        if max(map(len, chunks)) <= LONGEST_REMEMBERED:
            return b"".join(map(self.remembered, chunks))
        return b"".join(self.remembered(c) if len(c) <= LONGEST_REMEMBERED else self._chunk_ids(c) for c in chunks)


def _joined_bytes(raw: bytes) -> str:
    """UTF-8 characters, and one replacement character for each byte outside them."""
    try:
        return raw.decode()
    except UnicodeDecodeError as bad:
        return raw[:bad.start].decode() + "�" + _joined_bytes(raw[bad.start + 1:])


class Decoder:
    """Texts of id lists."""

    def __init__(self, model: dict):
        self.texts = [p.replace(MARK, " ") for p in model["pieces"]]
        for i in model["silent"]:
            self.texts[i] = ""
        for i, text in model["unknown"].items():
            self.texts[i] = text
        self.byte = {i: b for b, i in model["bytes"].items()}
        self.special = set(self.byte) | set(model["silent"])
        self.model = model
        # for whole columns: every piece's own text, and the ids whose text depends on their neighbours
        alone = {i: chr(b) for i, b in self.byte.items() if b < 128}
        self.column = pa.array([alone.get(i, text) for i, text in enumerate(self.texts)], pa.string())
        self.bound = np.array([i in self.special and i not in alone for i in range(len(self.texts))])
        self.marked = np.array([p.startswith(MARK) for p in model["pieces"]]) & model["prefix"]

    def column_of(self, lists: pa.ListArray) -> pa.Array:
        """The texts of a column of id lists: joined by Arrow, list by list only where ids depend on their neighbours."""
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(sizes))
        flat = lists.flatten()
        ids = flat.to_numpy(zero_copy_only=False)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.column.take(flat)), "")
        first = ids[np.minimum(ends[:-1], max(len(ids) - 1, 0))] if len(ids) else np.zeros(len(sizes), np.int32)
        own_mark = pa.array(self.marked[first] & (sizes > 0))
        texts = pc.if_else(own_mark, pc.utf8_slice_codeunits(joined, 1), joined)
        bound = np.append(0, np.cumsum(self.bound[ids]))
        odd = np.flatnonzero(bound[ends[1:]] > bound[ends[:-1]])
        if not len(odd):
            return texts
        mask = np.zeros(len(sizes), bool)
        mask[odd] = True
        return pc.replace_with_mask(texts, pa.array(mask), pa.array([self.text(ids[ends[i]:ends[i + 1]].tolist()) for i in odd], pa.string()))

    def text(self, ids: list[int]) -> str:
        texts, out = self.texts, []
        if not self.special.intersection(ids):
            out = [texts[i] for i in ids]
        else:
            held = bytearray()
            for i in ids:
                if i in self.byte:
                    held.append(self.byte[i])
                    continue
                if held:
                    out.append(_joined_bytes(bytes(held)))
                    held.clear()
                out.append(texts[i])
            out.append(_joined_bytes(bytes(held)))
        whole = "".join(out)
        # the mark before the first piece stands for no space of the text
        first = next((i for i in ids if i not in self.model["silent"]), None)
        own_mark = first is not None and self.model["prefix"] and self.model["pieces"][first].startswith(MARK)
        return whole[1:] if own_mark else whole


def _made_once(shared, name: str, make):
    """One object per worker process: it is kept beside the broadcast model."""
    model = shared.value
    if name not in model:
        model[name] = make(model)
    return model[name]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in the array column ``out``; the model file is read on the driver only."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        encoder = _made_once(shared, "_encoder", Encoder)
        parts = [encoder.ids(text or "") for text in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, parts)]) // 4
        flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return docs.withColumn(out, ids_of(F.col(text_col)))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of its id lists in the column ``out``; null lists give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(load_model(model_path))
    bounded_batches(rows.sparkSession)

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        return _made_once(shared, "_decoder", Decoder).column_of(lists)
    return rows.withColumn(out, text_of(F.col(ids_col)))
