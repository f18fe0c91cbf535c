"""SimHash near-duplicates: pivot distance tables instead of comparing all pairs.

A fingerprint's distance to fixed reference fingerprints bounds its distance to any other fingerprint:
``|d(x, p) - d(y, p)| <= d(x, y)`` for every reference ``p``. Two kinds of references are used:

* Banded references. The 64 bits are cut into five bands; inside a band the references are the empty mask
  and every single bit. Distances inside disjoint bands add up, so a pair within three bits has equal
  coordinates for all references of at least two bands. These coordinates are the join key. (Whole-width
  references alone cannot be a key: between random fingerprints each keeps almost half of all pairs.)
* Whole-width references, seeded. In a bucket of equal keys a pair goes on only if no coordinate differs
  by more than the allowed distance.

Survivors are verified bit by bit. Equal fingerprints are merged before any comparison and a bucket hands
on a spanning forest of its links, so a large group of copies never becomes all its pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches, stored
from ramparts.llm.components import connected_components

SHINGLE = 3
DISTANCE = 3
BANDS = (13, 13, 13, 13, 12)
PIVOTS = 8
# A bucket above this many different fingerprints is split into pairs of chunks.
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(join(words), 42)]
    else:
        hashes = [digest(join(s), 42) for s in zip(*(words[i:] for i in range(shingle)))]
    counts, raw = np.zeros(64, np.int64), np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        counts += np.unpackbits(raw[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(shingle: int = SHINGLE):
    """Column function: text to signed 64-bit fingerprint."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return of


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, root of its component) of the given links; roots themselves are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def pivot_table(seed: int = 7, pivots: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, pivots, np.uint64, endpoint=False)


def _coordinates(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in pivots])


def _survivors(fps, coords, i, j, distance):
    """Of the pairs (i, j) those that no coordinate discards and the bits confirm."""
    for c in coords:
        near = np.abs(c[i] - c[j]) <= distance
        i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= distance
    return i[near], j[near]


def links_in_buckets(distance: int, pivots: np.ndarray):
    """mapInPandas step over rows sorted by (bucket, side, fp): spanning links inside every bucket."""
    def runs(batches):
        """Frames that end with a bucket: an unfinished bucket waits for the next batch."""
        rest: list = []
        for pdf in batches:
            if not len(pdf):
                continue
            same = (pdf["bucket"] == pdf["bucket"].iloc[-1]).to_numpy()
            cut = int(np.argmin(same[::-1])) if not same.all() else len(pdf)
            head = pdf.iloc[:len(pdf) - cut]
            if len(head):
                yield pd.concat([*rest, head]) if rest else head
                rest = []
            elif rest and rest[-1]["bucket"].iloc[-1] != pdf["bucket"].iloc[0]:
                yield pd.concat(rest)
                rest = []
            rest.append(pdf.iloc[len(pdf) - cut:])
        if rest:
            yield pd.concat(rest)

    def links(pdf):
        fps, bucket, side = pdf["fp"].to_numpy().view(np.uint64), pdf["bucket"].to_numpy(), pdf["side"].to_numpy()
        coords = _coordinates(fps, pivots)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        out_a, out_b = [], []
        small = np.repeat(sizes <= 64, sizes)
        for lag in range(1, min(64, int(sizes.max()))):
            i = np.flatnonzero(small[:-lag] & (bucket[lag:] == bucket[:-lag]) & ((side[lag:] != side[:-lag]) | (side[lag:] < 0)))
            i, j = _survivors(fps, coords, i, i + lag, distance)
            out_a.append(fps[i])
            out_b.append(fps[j])
        for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
            part, at, one = slice(start, start + size), np.arange(size), side[start:start + size]
            f, c = fps[part], coords[:, part]
            for low in range(0, size, 256):
                rows = at[low:low + 256]
                near = (at[None, :] > rows[:, None]) & ((one[None, :] != one[rows][:, None]) | (one[rows][:, None] < 0))
                for k in c:
                    near &= np.abs(k[None, :] - k[rows][:, None]) <= distance
                i, j = np.nonzero(near)
                i, j = _survivors(f, c[:0], rows[i], j, distance)
                a, b = forest(f[i], f[j])
                out_a.append(a)
                out_b.append(b)
        return forest(np.concatenate([*out_a, fps[:0]]), np.concatenate([*out_b, fps[:0]]))

    def step(batches):
        for pdf in runs(batches):
            a, b = links(pdf)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
    return step


def banded(fps: DataFrame, distance: int = DISTANCE, bands: tuple[int, ...] = BANDS) -> DataFrame:
    """``fp`` once per choice of bands that a near pair can leave untouched, with the key of their coordinates."""
    offsets = [sum(bands[:i]) for i in range(len(bands))]
    coords = []
    for offset, width in zip(offsets, bands):
        part = F.shiftrightunsigned(F.col("fp"), offset).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        refs = [0, *(1 << r for r in range(width))]
        coords.append(F.array(*(F.bit_count(part.bitwiseXOR(F.lit(r).cast("long"))) for r in refs)))
    table = fps.select("fp", *(c.alias(f"c{i}") for i, c in enumerate(coords)))
    choices = itertools.combinations(range(len(bands)), len(bands) - distance)
    keys = F.array(*(F.xxhash64(F.lit(n), *(F.col(f"c{i}") for i in choice)) for n, choice in enumerate(choices)))
    return table.select("fp", F.explode(keys).alias("key"))


def near_fingerprints(fps: DataFrame, distance: int = DISTANCE, bands: tuple[int, ...] = BANDS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the different fingerprints within ``distance`` bits of each other.

    ``fps`` has one column ``fp`` of different values. The result spans the components; it does not list
    every pair. A bucket above ``bucket`` rows becomes pairs of chunks, each a task's work of its own.
    """
    if len(bands) <= distance:
        raise ValueError("more bands than differing bits are needed")
    keyed = banded(fps, distance, bands)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / (bucket / 2)).cast("int")
    rows = keyed.join(counts, "key").withColumn("chunks", F.when(F.col("n") > bucket, chunks).otherwise(F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # side: -1 in a bucket that is compared with itself, else the chunk, so that only different chunks meet
    rows = rows.select("fp", pair.alias("bucket"), F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own")).alias("side"))
    return (rows.repartition("bucket").sortWithinPartitions("bucket", "side", "fp")
            .mapInPandas(links_in_buckets(distance, pivot_table()), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """``(id, fp, component_id)`` per row of ``docs``: texts linked by fingerprints within ``distance`` bits.

    ``component_id`` is the smallest id reachable, the row's own id included. A null text counts as empty,
    all texts without words share fingerprint 0; a null id takes part in links and gives no id (a component
    of null ids only has a null ``component_id``). Repeated rows stay repeated. An empty table gives no rows.
    Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = stored(docs.select(F.col(id_col).alias("id"), fingerprints(shingle)(F.col(text_col)).alias("fp")), "fingerprints")
    first = stored(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "different")
    roots = stored(connected_components(near_fingerprints(first.select("fp"), distance), "a", "b"), "roots")
    grouped = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(grouped.join(lowest, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
