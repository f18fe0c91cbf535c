"""Benchmark decontamination by latent semantic retrieval.

Benchmark texts are cut into pieces of at most ``PIECE_WORDS`` words. Terms weigh their count times an inverse
document frequency taken over all documents. A randomised SVD of the pieces' weights, computed as joins and
sums over (piece, term) rows with a seeded random start and one power step, gives every term a latent vector;
only matrices of ``RANK`` + ``OVERSAMPLE`` columns squared come to the driver. All documents then pass once:
windows of twice a piece, moved by a piece's length, so that every piece lies whole in some window, are
projected, and pieces within ``COSINE`` are candidates. So are, by an exact way, all pieces that the cut loses:
of a piece's weighted words the commonest that together are fewer than a leak takes are set aside, and any window
that holds one of the others is compared word by word. A candidate is a leak if in a span of the window of at most
``SPAN`` times its length the longest common subsequence covers ``LCS_ALONE`` of its words and of its weighted
words, or ``LCS`` of both and ``ANSWER`` of the weighted ones of its closing ``ANSWER_WORDS`` words, where a
question's answer stands. Where no word has weight, all count.

The benchmark is a query set: it is taken in blocks of ``BLOCK_PIECES`` pieces, each with its own SVD, and a
block's term table is what tasks receive. Documents are neither shuffled nor cut.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches, stored

PIECE_WORDS = 64
RANK, OVERSAMPLE = 128, 16
BLOCK_PIECES = 4096
LEAST_IDF = 1.0
COSINE = 0.4
LCS, LCS_ALONE = 0.5, 0.65
ANSWER, ANSWER_WORDS = 0.5, 6
SPAN = 1.5
LEAST_WORDS = 4
# Texts are searched together until they hold so many words.
GROUP_WORDS = 1 << 15
_WORD = re.compile(r"\w+")
# the same words of an ASCII text by a faster way: everything else becomes a blank
_ASCII = str.maketrans({chr(c): " " for c in range(128) if not _WORD.match(chr(c))})


def words_of(text: str | None) -> list[str]:
    low = (text or "").lower()
    return low.translate(_ASCII).split() if low.isascii() else _WORD.findall(low)


def pieces_of(text: str | None, size: int = PIECE_WORDS) -> list[list[str]]:
    """Overlapping pieces of a benchmark text; the last one ends with the text."""
    words = words_of(text)
    if len(words) <= size:
        return [words] if words else []
    starts = [*range(0, len(words) - size, size // 2), len(words) - size]
    return [words[s:s + size] for s in starts]


def places_of(piece: list[str]) -> dict[str, int]:
    """Where each word stands in a piece, as bits."""
    masks: dict[str, int] = {}
    for i, w in enumerate(piece):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def common_subsequence(masks: dict[str, int], size: int, window: list[str]) -> int:
    """Length of the longest common subsequence of words, bit-parallel; the piece is given by its words' places."""
    row = full = (1 << size) - 1
    for m in filter(None, map(masks.get, window)):
        u = row & m
        row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def _document_counts(docs: DataFrame, text_col: str, vocabulary: frozenset) -> tuple[dict[str, int], int]:
    """In how many of all documents each term stands, and how many there are."""
    def count(batches):
        total: dict[str, int] = {}
        n = 0
        for pdf in batches:
            for text in pdf["text"]:
                n += 1
                for w in vocabulary.intersection(words_of(text)):
                    total[w] = total.get(w, 0) + 1
        yield pd.DataFrame({"term": [*total, None], "n": [*total.values(), n]})
    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found, found.pop(None, 0)


def _times(entries: DataFrame, vectors: DataFrame, on: str, to: str) -> DataFrame:
    """Sparse matrix times dense rows ``(on, dim, v)``, as ``(to, dim, v)``."""
    return entries.join(vectors, on).groupBy(to, "dim").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def _gram(rows: DataFrame, key: str, width: int) -> np.ndarray:
    """Sum of the outer products of all rows: a ``width`` x ``width`` matrix."""
    def part(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            m = np.zeros((len(pdf), width))
            for i, (dims, values) in enumerate(zip(pdf["dims"], pdf["values"])):
                m[i, np.asarray(dims, int)] = values
            total += m.T @ m
        yield pd.DataFrame({"g": [total.tobytes()]})
    lists = rows.groupBy(key).agg(F.collect_list("dim").alias("dims"), F.collect_list("v").alias("values")).select("dims", "values")
    return sum((np.frombuffer(r["g"]).reshape(width, width) for r in lists.mapInPandas(part, "g binary").collect()), np.zeros((width, width)))


def _inverse_root(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(square roots of the eigenvalues, basis that makes the rows orthonormal), directions without weight dropped."""
    values, basis = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    order = order[values[order] > max(values.max(), 0) * 1e-10]
    size = np.sqrt(values[order])
    return size, basis[:, order] / size


def latent_terms(spark, pieces: list[list[str]], idf: dict[str, float], rank: int = RANK, oversample: int = OVERSAMPLE) -> dict[str, np.ndarray]:
    """Latent vector per weighted term: right singular vectors of the pieces' normalised weights."""
    entries = []
    for i, piece in enumerate(pieces):
        weights = {}
        for w in piece:
            if w in idf:
                weights[w] = weights.get(w, 0.0) + idf[w]
        size = np.sqrt(sum(x * x for x in weights.values()))
        entries += [(i, w, float(x / size)) for w, x in weights.items()]
    if not entries:
        return {}
    width = rank + oversample
    table = stored(spark.createDataFrame(entries, "piece int, term string, w double"), "weights")

    def start(batches):
        for pdf in batches:
            for term in pdf["term"]:
                rng = np.random.default_rng(xxhash.xxh64_intdigest(term.encode()))
                yield pd.DataFrame({"term": term, "dim": np.arange(width), "v": rng.normal(size=width)})
    omega = table.select("term").distinct().mapInPandas(start, "term string, dim int, v double")
    spread = stored(_times(table, _times(table, omega, "term", "piece"), "piece", "term"), "power")
    seen = stored(_times(table, spread, "term", "piece"), "range")
    _, whiten = _inverse_root(_gram(seen, "piece", width))
    back = stored(_times(table, seen, "piece", "term"), "back")
    size, basis = _inverse_root(whiten.T @ _gram(back, "term", width) @ whiten)
    turn = (whiten @ basis)[:, :rank]
    vectors: dict[str, np.ndarray] = {}
    for r in back.groupBy("term").agg(F.collect_list("dim").alias("dims"), F.collect_list("v").alias("values")).toLocalIterator():
        row = np.zeros(width)
        row[r["dims"]] = r["values"]
        vectors[r["term"]] = row @ turn
    return vectors


def deciding_words(piece: list[str], least: float, rarity: dict[str, float]) -> list[str]:
    """Words of a piece of which every window with a share of ``least`` holds one.

    The commonest words that together are fewer than ``least`` of the piece do not make a leak by themselves.
    """
    left, out = least * len(piece) - 1e-9, []
    for w, n in sorted(Counter(piece).items(), key=lambda x: (rarity[x[0]], x[0])):
        left -= n
        if left <= 0:
            out.append(w)
    return out


def leak_spans(places: list[int], counted: int, span: int, least: float, least_counted: float):
    """Begins of the spans of a window that hold enough words of a piece and enough of its counted words, in any order.

    ``places``: for each word of the window where it stands in the piece, as bits; ``counted``: the places that count.
    """
    ends = [k for k, m in enumerate(places) if m]
    end = words = weighted = 0
    for n, begin in enumerate(ends):
        while end < len(ends) and ends[end] < begin + span:
            words, weighted = words + 1, weighted + bool(places[ends[end]] & counted)
            end += 1
        if words >= least and weighted >= least_counted:
            yield begin
        words, weighted = words - 1, weighted - bool(places[begin] & counted)


def _finder(pieces, items, idf, rarity, latent, cosine, lcs, lcs_alone, answer):
    terms = sorted(latent)
    # weighted terms first, then the other words of the pieces
    number = {w: i for i, w in enumerate([*terms, *sorted({w for p in pieces for w in p} - latent.keys())])}
    loading = np.stack([latent[w] * idf[w] for w in terms]).astype(np.float32)
    targets = np.zeros((len(pieces), loading.shape[1]), np.float32)
    for i, piece in enumerate(pieces):
        for w in piece:
            if w in latent:
                targets[i] += loading[number[w]]
    targets /= np.maximum(np.sqrt((targets * targets).sum(1, keepdims=True)), 1e-9)
    step = PIECE_WORDS
    def weighty(words):
        return [w for w in words if w in idf] or words
    heavy, closing = [weighty(p) for p in pieces], [weighty(p[-ANSWER_WORDS:]) for p in pieces]
    masks, heavy_masks, closing_masks = ([places_of(p) for p in ps] for ps in (pieces, heavy, closing))
    counted = [sum(m for w, m in masks[j].items() if w in heavy_masks[j]) for j in range(len(pieces))]
    sizes, heavy_sizes = np.array([len(p) for p in pieces]), np.array([len(p) for p in heavy])
    columns = -(-(len(number) + 1) // 64) * 64
    chunk = max(16, min(2048, (1 << 23) // columns))
    distinct, heavy_distinct = np.array([len(m) for m in masks]), np.array([len(m) for m in heavy_masks])
    least = min(lcs, lcs_alone)
    # the pieces that each word decides on, one word after the other
    decided: list[list[int]] = [[] for _ in number]
    for j, piece in enumerate(pieces):
        for w in deciding_words(heavy[j], least, rarity):
            decided[number[w]].append(j)
    n_decided = np.array([*map(len, decided), 0])  # the last one for words of no piece
    first_decided, decided = np.append(0, np.cumsum(n_decided)), np.array([j for js in decided for j in js])

    def bits(rows, numbers, count):
        """Which words each row holds, as packed bits; words of no piece have the number -1, the last bit."""
        held = np.zeros((count, columns), bool)
        held[rows, numbers] = True
        return np.packbits(held, axis=1).view(np.uint64)
    contents, heavy_contents = (np.concatenate([bits(0, [number[w] for w in p], 1) for p in ps]) for ps in (pieces, heavy))

    def limits(i, j, ids, first):
        """Upper limits of the shares, of all and of weighted words: a piece's different words that the window lacks are in no common subsequence."""
        windows, at = np.unique(i, return_inverse=True)
        place = np.minimum(first[windows][:, None] * step + np.arange(2 * step), len(ids) - 1)
        held = bits(np.arange(len(windows))[:, None], ids[place], len(windows))

        def limit(sizes, distinct, contents):
            both = [np.bitwise_count(held[at[k:k + 16384]] & contents[j[k:k + 16384]]).sum(1, dtype=np.int64) for k in range(0, len(i), 16384)]
            return (sizes[j] - distinct[j] + np.concatenate(both)) / sizes[j]
        return limit(sizes, distinct, contents), limit(heavy_sizes, heavy_distinct, heavy_contents)

    def leaked(j, window):
        """Whether a piece stands in a window, close together."""
        size, heavy_size = len(pieces[j]), len(heavy[j])
        span = ceil(SPAN * size)
        for begin in leak_spans([masks[j].get(w, 0) for w in window], counted[j], span, least * size, least * heavy_size):
            part = window[begin:begin + span]
            share = common_subsequence(masks[j], size, part) / size
            if share >= least:
                share = min(share, common_subsequence(heavy_masks[j], heavy_size, part) / heavy_size)
            if share >= lcs_alone or share >= lcs and common_subsequence(closing_masks[j], len(closing[j]), part) >= answer * len(closing[j]):
                return True
        return False

    def held_pairs(ids, begins):
        """Windows with deciding words of pieces, as sorted numbers window * pieces + piece."""
        at = np.flatnonzero(n_decided[ids])
        block, word = np.divmod(np.unique(at // step * len(number) + ids[at]), len(number))
        n = n_decided[word]
        block = np.repeat(block, n)
        piece = decided[np.repeat(first_decided[word] - np.cumsum(n) + n, n) + np.arange(len(block))]
        # a window is a block and the next
        before = ~np.isin(block, begins)
        return np.unique(np.append(block * len(pieces) + piece, (block[before] - 1) * len(pieces) + piece[before]))

    def leaks(texts):
        """(items, best cosine, best share of a piece found) of each of some whole texts, laid out in one row of blocks.

        A text begins with a block of its own and ends with an empty block, so no window holds words of two texts.
        """
        words, begins = [], []
        for mine in texts:
            begins.append(len(words) // step)
            words += mine
            words += [""] * (-len(mine) % step + step)
        begins = np.array(begins)
        found, best_cos, best_lcs = [set() for _ in texts], np.zeros(len(texts)), [0.0] * len(texts)
        ids = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
        held = held_pairs(ids, begins)
        at = np.flatnonzero(ids.view(np.uint32) < len(terms))
        weighted = ids[at]
        blocks, first = np.unique(at // step, return_index=True)
        bounds = np.append(first, len(at))
        sums = [np.add.reduceat(loading[weighted[bounds[k]:bounds[min(k + 256, len(blocks))]]], first[k:k + 256] - first[k], 0)
                for k in range(0, len(blocks), 256)]
        sums = np.concatenate([*sums, np.zeros((1, loading.shape[1]), np.float32)])
        # a window is a block and the next; a block without known terms stands for zeros (the last row)
        starts = np.unique(np.concatenate([blocks, blocks[~np.isin(blocks, begins)] - 1, held // len(pieces)]))
        row = np.full(len(words) // step + 1, len(blocks))
        row[blocks] = np.arange(len(blocks))
        for k in range(0, len(starts), chunk):
            mine = starts[k:k + chunk]
            text = np.searchsorted(begins, mine, "right") - 1
            m = sums[row[mine]] + sums[row[mine + 1]]
            m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)
            near = m @ targets.T
            np.maximum.at(best_cos, text, near.max(1))
            exact = held[slice(*np.searchsorted(held, (mine[0] * len(pieces), (mine[-1] + 1) * len(pieces))))]
            exact = exact[near[np.searchsorted(mine, exact // len(pieces)), exact % len(pieces)] < cosine]
            i, j = np.nonzero(near >= cosine)
            n_near = len(i)
            i, j = np.append(i, np.searchsorted(mine, exact // len(pieces))), np.append(j, exact % len(pieces))
            if not len(i):
                continue
            limit, heavy_limit = limits(i, j, ids, mine)
            can = (limit >= least) & (heavy_limit >= least)
            able = np.flatnonzero(can | (np.arange(len(i)) < n_near))
            i, j, limit, can, of = i[able], j[able], limit[able], can[able], text[i[able]]
            order = np.lexsort((-limit, of))
            for n, t, high, may in zip(order.tolist(), of[order].tolist(), limit[order].tolist(), can[order].tolist()):
                if not may and high <= best_lcs[t]:
                    continue
                low, j_n = int(mine[i[n]]) * step, int(j[n])
                window, size = words[low:low + 2 * step], int(sizes[j_n])
                share = common_subsequence(masks[j_n], size, window) / size
                best_lcs[t] = max(best_lcs[t], share)
                if may and share >= least and items[j_n] not in found[t] and leaked(j_n, window):
                    found[t].add(items[j_n])
        return list(zip(map(sorted, found), best_cos, best_lcs))

    def groups(texts):
        """Some texts' words at a time; a long text stands alone."""
        held, total = [], 0
        for text in texts:
            words = words_of(text)
            if held and total + len(words) > GROUP_WORDS:
                yield held
                held, total = [], 0
            held.append(words)
            total += len(words)
        if held:
            yield held

    @F.pandas_udf("items array<long>, cosine double, lcs double")
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([r for group in groups(texts) for r in leaks(group)], columns=["items", "cosine", "lcs"])
    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE,
               lcs: float = LCS, lcs_alone: float = LCS_ALONE, answer: float = ANSWER) -> DataFrame:
    """``docs`` with ``leaked_items`` (sorted ids), ``best_cosine``, ``best_lcs`` and ``contaminated``; columns of these names are replaced.

    A null or empty text has no leaks. Items that are null, without id, or shorter than ``LEAST_WORDS`` words are
    not searched. Repeated rows get equal results; of repeated items each counts. Without documents or items
    nothing is contaminated. Terms in over ``exp(-LEAST_IDF)`` of all documents carry no weight.
    """
    bounded_batches(docs.sparkSession)
    n_items = benchmark.count()
    blocks = max(1, ceil(n_items / BLOCK_PIECES))
    out, parts = docs, []
    for b in range(blocks):
        mine = benchmark.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull() & (F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b))
        split = [(p, r[0]) for r in mine.select(F.col(item_id).cast("long"), item_text).collect() for p in pieces_of(r[1])]
        split = [(p, i) for p, i in split if len(p) >= LEAST_WORDS]
        pieces, items = [p for p, _ in split], [i for _, i in split]
        counts, total = _document_counts(docs, text_col, frozenset(w for p in pieces for w in p))
        idf = {w: float(np.log((total + 1) / (counts.get(w, 0) + 1))) for p in pieces for w in p}
        rarity, idf = idf, {w: x for w, x in idf.items() if x >= LEAST_IDF} or idf
        latent = {w: v for w, v in latent_terms(docs.sparkSession, pieces, idf).items() if w in idf} if total and pieces else {}
        if latent:
            parts.append(f"_leak{b}")
            out = out.withColumn(parts[-1], _finder(pieces, items, idf, rarity, latent, cosine, lcs, lcs_alone, answer)(F.col(text_col)))
    none = F.array().cast("array<long>")
    items = F.array_sort(F.array_distinct(F.concat(none, *(F.col(f"{p}.items") for p in parts))))
    best = {k: F.greatest(F.lit(0.0), F.lit(0.0), *(F.col(f"{p}.{k}") for p in parts)) for k in ("cosine", "lcs")}
    out = out.withColumns({"leaked_items": items, "best_cosine": best["cosine"], "best_lcs": best["lcs"]})
    return out.withColumn("contaminated", F.size("leaked_items") > 0).drop(*parts)
