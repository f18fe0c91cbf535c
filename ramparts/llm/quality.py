"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded, ``FILTERS`` filters of ``WIDTH`` bytes run over the whole text with a step of ``STEP``,
a rectifier follows, and every chunk of ``CHUNK`` bytes (a quarter shared with the next one) keeps each
filter's maximum. The largest and the mean chunk maximum of every filter are combined by a logistic unit
into one probability. Embedding, filters and the unit are learned together by back-propagation on at most
``TRAIN_ROWS`` labelled rows of each class, whole texts.

For scoring, embedding and filters are folded into tables over byte pairs, so a filter response is a sum
of four table rows. A text is read in pieces of bounded size; only block maxima are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches, training_rows

EMBED, FILTERS, WIDTH, STEP = 6, 16, 8, 4
BLOCK, CHUNK = 128, 512
TRAIN_ROWS = 1_200
EPOCHS = 6
THRESHOLD = 0.5
PIECE = 1 << 16


def _padded(text: str | None) -> np.ndarray:
    """The bytes of a text, filled up with zeros to whole blocks plus a filter's reach."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // BLOCK)) * BLOCK + WIDTH - STEP
    out = np.zeros(size, np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _chunks(blocks: int) -> tuple[np.ndarray, int]:
    """First blocks of the overlapping chunks that cover ``blocks`` blocks, and a chunk's length in blocks."""
    size = CHUNK // BLOCK
    return np.arange(0, max(1, blocks - 1), size - 1), size


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 3):
    """Learned parameters; without both classes a network whose output is the label rate."""
    rng = np.random.default_rng(seed)
    y = np.array([label for _, label in rows], np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    net = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)),
           "shift": np.zeros(FILTERS), "out": np.zeros(2 * FILTERS), "bias": np.array([np.log(rate / (1 - rate))])}
    if not y.sum() or y.sum() == len(y):
        return net
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    data = [_padded(text) for text, _ in rows]
    net["bias"][:] = 0
    net["out"][:] = rng.normal(0, 0.1, 2 * FILTERS)
    m, v, step = {k: np.zeros_like(x) for k, x in net.items()}, {k: np.zeros_like(x) for k, x in net.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for low in range(0, len(order), 16):
            grad = {k: np.zeros_like(x) for k, x in net.items()}
            table = np.einsum("be,kef->kbf", net["embed"], net["filters"]).astype(np.float32)
            for i in order[low:low + 16]:
                codes = data[i]
                count = (len(codes) - WIDTH + STEP) // STEP
                reply = sum(table[k][codes[k:k + count * STEP:STEP]] for k in range(WIDTH)) + net["shift"].astype(np.float32)
                blocks = reply.reshape(-1, BLOCK // STEP, FILTERS)
                best, top = blocks.argmax(1), blocks.max(1)
                first, size = _chunks(len(top))
                spans = np.minimum(first[:, None] + np.arange(size), len(top) - 1)
                inner = top[spans].argmax(1)
                block = spans[np.arange(len(first))[:, None], inner]
                raw = top[block, np.arange(FILTERS)]
                pooled = np.maximum(raw, 0)
                most = pooled.argmax(0)
                joined = np.concatenate([pooled.max(0), pooled.mean(0)])
                prob = 1 / (1 + np.exp(-np.clip(joined @ net["out"] + net["bias"][0], -30, 30)))
                slope = (prob - y[i]) * share[i] / 16
                grad["out"] += slope * joined
                grad["bias"] += slope
                back = np.repeat(slope * net["out"][None, FILTERS:] / len(first), len(first), 0)
                back[most, np.arange(FILTERS)] += slope * net["out"][:FILTERS]
                back *= raw > 0
                at = (block * (BLOCK // STEP) + best[block, np.arange(FILTERS)]) * STEP
                grad["shift"] += back.sum(0)
                for k in range(WIDTH):
                    seen = codes[at + k]
                    grad["filters"][k] += np.einsum("cfe,cf->ef", net["embed"][seen], back)
                    np.add.at(grad["embed"], seen, np.einsum("ef,cf->cfe", net["filters"][k], back))
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * net[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                net[k] -= 0.01 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def pair_tables(net) -> np.ndarray:
    """Filter responses by byte pair: ``(WIDTH / 2, 65536, FILTERS)``; a pair is low byte first."""
    table = np.einsum("be,kef->kbf", net["embed"], net["filters"])
    pairs = table[0::2][:, None, :, :] + table[1::2][:, :, None, :]
    return np.ascontiguousarray(pairs.reshape(WIDTH // 2, 65536, FILTERS), np.float32)


def probability(text: str | None, pairs: np.ndarray, net) -> float:
    """The network's output for one whole text."""
    codes, tops = _padded(text), []
    for low in range(0, len(codes) - WIDTH + STEP, PIECE):
        part = np.ascontiguousarray(codes[low:low + PIECE + WIDTH - STEP])
        words = part[:len(part) // 2 * 2].view("<u2")
        count = (len(part) - WIDTH + STEP) // STEP
        reply = pairs[0].take(words[0:count * 2:2], 0)
        for k in range(1, WIDTH // 2):
            reply += pairs[k].take(words[k:k + count * 2:2], 0)
        tops.append(reply.reshape(-1, BLOCK // STEP, FILTERS).max(1))
    top = np.concatenate(tops) + net["shift"].astype(np.float32)
    first, size = _chunks(len(top))
    pooled = np.maximum(top[np.minimum(first[:, None] + np.arange(size), len(top) - 1)].max(1), 0)
    joined = np.concatenate([pooled.max(0), pooled.mean(0)]).astype(np.float64)
    return float(1 / (1 + np.exp(-np.clip(joined @ net["out"] + net["bias"][0], -30, 30))))


def _scorer(net):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = pair_tables(net)
        for texts in batches:
            yield pd.Series([probability(t, pairs, net) for t in texts], dtype="float64")
    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  max_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted``; existing columns of these names are replaced.

    A null text counts as empty; empty texts get the network's value for a chunk of zeros. Null ids are
    scored too, repeated rows get the same score. Without labels of both kinds every score is the label rate.
    An empty table gives no rows. Only the text enters a score.
    """
    bounded_batches(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows).orderBy(F.xxhash64("_text")).collect()
    net = fit([(r["_text"], int(r["_label"])) for r in rows])
    scored = docs.withColumn("score", _scorer(net)(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
