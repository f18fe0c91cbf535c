"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the different character n-grams (``ORDERS``) of the lower-cased text, hashed into ``2 ** BITS``
places. A feature's value is its log-count ratio: how much likelier it is in toxic than in other training
texts, smoothed. Logistic regression with an L2 penalty learns weights on these values. Long texts add up
many small ratios of chance, so only n-grams whose difference between the classes is beyond chance keep a
ratio (``LEAST_Z`` standard deviations).

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows of each class, in order of a hash of their id. Scoring is
one pass over whole texts, in pieces of bounded size, with a table of ``2 ** BITS`` floats per task.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches, training_rows

ORDERS = (4, 5)
BITS = 20
TRAIN_ROWS = 1_500
LEAST_Z = 2.5
THRESHOLD = 0.7
PIECE = 1 << 17
_BLANK = re.compile(r"\s+")


def _places(text: str | None, orders=ORDERS, bits: int = BITS):
    """Arrays of hashed n-grams of a text, piece by piece; pieces overlap so that no n-gram is lost."""
    clean = f" {_BLANK.sub(' ', (text or '').lower())} "
    last = max(orders) - 1
    for start in range(0, max(1, len(clean) - last), PIECE):
        codes = np.frombuffer(clean[start:start + PIECE + last].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(orders) + 1):
            if len(codes) < n:
                break
            h = h[:len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:] + np.uint64(n)
            if n in orders:
                mixed = h ^ (h >> np.uint64(29))
                yield ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, orders=ORDERS, bits: int = BITS) -> np.ndarray:
    """The different places of a whole text."""
    parts = [np.unique(p) for p in _places(text, orders, bits)]
    return np.unique(np.concatenate(parts)).astype(np.int32) if parts else np.zeros(0, np.int32)


def _extractor():
    @F.pandas_udf("binary")
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts])
    return extract


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, steps: int = 400, penalty: float = 1e-3, least_z: float = LEAST_Z):
    """(weight per place, bias) from (places, label) rows; without both classes the bias alone gives the rate."""
    y = np.array([label for _, label in rows], np.float64)
    p, n = y.sum(), len(y) - y.sum()
    weights, bias = np.zeros(1 << bits), float(np.log((p + 0.5) / (n + 0.5)))
    if not p or not n:
        return weights, bias
    count = np.zeros((2, 1 << bits))
    for places, label in rows:
        count[int(label), places] += 1
    ratio = np.log((count[1] + 0.1) / (p + 0.2)) - np.log((count[0] + 0.1) / (n + 0.2))
    rate = (count[0] + count[1] + 1) / (p + n + 2)
    z = (count[1] / p - count[0] / n) / np.sqrt(rate * (1 - rate) * (1 / p + 1 / n))
    used = np.flatnonzero((np.abs(z) >= least_z) & (count[0] + count[1] >= 3))
    at = np.full(1 << bits, -1)
    at[used] = np.arange(len(used))
    kept = [at[places][at[places] >= 0] for places, _ in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(k) for k in kept]), np.concatenate([*kept, np.zeros(0, np.int64)])
    # both classes weigh the same, however few rows one has
    value, w, b = ratio[used], np.full(len(used), 0.05), 0.0
    share = np.where(y == 1, 0.5 / p, 0.5 / n)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        prob = 1 / (1 + np.exp(-np.clip(np.bincount(row, (value * w)[col], len(rows)) + b, -40, 40)))
        slope = (prob - y) * share
        grad = np.append(np.bincount(col, slope[row], len(used)) * value + penalty * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights[used] = value * w
    return weights, float(b)


def _scorer(weights: np.ndarray, bias: float):
    table, known = weights.astype(np.float32), weights != 0

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            found = [p[known.take(p)] for p in _places(text)]
            places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            out[i] = bias + table[places].sum(dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))
    return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = TRAIN_ROWS):
    """Fit on at most ``max_rows`` labelled rows of each class that are not held out."""
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows).select(_extractor()("_text").alias("f"), "_label").collect()
    return fit([(np.frombuffer(r["f"], np.int32), int(r["_label"])) for r in rows])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   max_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); existing columns of these names are replaced.

    A null text counts as empty and gets the score of a text without known n-grams. Null ids are scored too.
    Repeated rows get the same score. Without labels of both kinds every score is the label rate. An empty
    table gives no rows. Only the text enters a score.
    """
    bounded_batches(docs.sparkSession)
    weights, bias = train(docs, labels, id_col, text_col, label_col, max_rows)
    scored = docs.withColumn("score", _scorer(weights, bias)(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
