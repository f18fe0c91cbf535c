"""Embedding near-duplicates by collision-counting projections.

Every unit vector is projected on ``PROJECTIONS`` random lines. Around a query's projection lies a window of
half width ``window``; a near pair collides in nearly all windows, another pair in about a third of them. Pairs
that collide at least ``least`` times are verified by their cosine in double precision. ``least`` is the largest
count that a pair just at the cosine limit reaches with probability ``RECALL`` (normal differences, binomial
count). A wider window on a leading projection, kept by such a pair in 997 of 1000 cases, leaves only pairs
of neighbouring cells of that line to be counted.

Equal vectors of a label are merged first. Cells are cut into chunks of ``CHUNK`` vectors, and every pair of
chunks of the same or neighbouring cells is one group of bounded size, so a label of any share spreads over
tasks. A group hands on link counts per vector and a spanning forest, not its pairs. The counting itself
grows with the square of a cell, at one comparison per pair and projection.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import stored
from ramparts.llm.components import connected_components
from ramparts.llm.simhash import forest

COSINE = 0.93
PROJECTIONS = 24
WINDOW = 0.7
LEADING = 1.11
RECALL = 0.999
CHUNK = 1024
SEED = 23


def least_collisions(cosine: float = COSINE, projections: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """Collisions a pair at the limit reaches with probability ``recall``."""
    p = erf(window / sqrt(2 - 2 * cosine) / sqrt(2))
    total = 0.0
    for k in range(projections, -1, -1):
        total += comb(projections, k) * p ** k * (1 - p) ** (projections - k)
        if total >= recall:
            return k
    return 0


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _lines(dims: int, count: int) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(count, dims))


def _cells(leading: float):
    """Cell of the leading projection; vectors of one length are projected together."""
    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        sizes = np.array([len(v) for v in vectors])
        for dims in np.unique(sizes):
            at = np.flatnonzero(sizes == dims)
            unit = _unit(np.stack([np.asarray(vectors.iloc[i], np.float64) for i in at]))
            out[at] = np.floor(unit @ _lines(dims, PROJECTIONS + 1)[0] / leading)
        return pd.Series(out)
    return cell


def _count_links(cosine: float, window: float, least: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = pdf["side"].to_numpy()
        same = bool((sides < 0).any())
        a, b = (pdf, pdf) if same else (pdf[sides == 0], pdf[sides == 1])
        empty = pd.DataFrame({"key": pd.Series(dtype="int64"), "other": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
        if not len(a) or not len(b):
            return empty
        lines = _lines(len(pdf["vec"].iloc[0]), PROJECTIONS + 1)[1:]
        ua, ub = (_unit(np.stack(x["vec"].to_numpy()).astype(np.float64)) for x in (a, b))
        pa, pb = ua @ lines.T, ub @ lines.T
        hits = np.zeros((len(a), len(b)), np.int8)
        for i in range(len(lines)):
            order = np.argsort(pb[:, i])
            place = np.empty(len(b), np.int32)
            place[order] = np.arange(len(b))
            low = np.searchsorted(pb[order, i], pa[:, i] - window, "left")
            high = np.searchsorted(pb[order, i], pa[:, i] + window, "right")
            hits += (place[None, :] >= low[:, None]) & (place[None, :] < high[:, None])
        i, j = np.nonzero(hits >= least)
        if same:
            i, j = i[i < j], j[i < j]
        near = np.concatenate([np.einsum("rd,rd->r", ua[i[k:k + 65536]], ub[j[k:k + 65536]]) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])
        i, j = i[near], j[near]
        if not len(i):
            return empty
        ka, kb, ca, cb = a["key"].to_numpy(), b["key"].to_numpy(), a["copies"].to_numpy(), b["copies"].to_numpy()
        counts = pd.DataFrame({"key": np.concatenate([ka[i], kb[j]]), "n": np.concatenate([cb[j], ca[i]])}).groupby("key", as_index=False)["n"].sum()
        one, other = forest(ka[i], kb[j])
        return pd.concat([pd.DataFrame({"key": counts["key"], "other": -1, "n": counts["n"]}), pd.DataFrame({"key": one, "other": other, "n": 0})])
    return of


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
                 window: float = WINDOW, leading: float = LEADING, chunk: int = CHUNK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row: links between rows of one label with ``cosine`` or more.

    Rows with a null label, and vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing: 0 links, their own id, kept. Vectors of different length never link. Repeated rows and
    copies are linked with each other. A null id counts as a vector; a component takes the smallest id that is
    not null. An empty table gives no rows. Other columns are not read.
    """
    if cosine < COSINE - 1e-9:
        raise ValueError("window and leading are set for this cosine or more")
    vec = F.col(vector_col)
    finite = F.forall(vec, lambda x: F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = F.coalesce(F.col(label_col).isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vec.alias("vec"), fit.alias("fit"))
    groups = stored(rows.filter("fit").groupBy("label", "vec").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("copies"))
                    .withColumn("key", F.monotonically_increasing_id()).withColumn("cell", _cells(leading)("vec"))
                    .withColumn("dims", F.size("vec")), "vectors")
    cell = ["label", "dims", "cell"]
    chunks = groups.groupBy(*cell).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    placed = groups.join(chunks, cell).withColumn("part", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    parts = chunks.select(*cell, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
    # every pair of chunks of one cell, and of a cell and the next
    ahead = parts.select("label", "dims", F.explode(F.array(F.col("cell"), F.col("cell") - 1)).alias("cell"), F.col("cell").alias("cell_b"), F.col("part").alias("part_b"))
    pairs = parts.join(ahead, cell).filter("cell < cell_b OR part <= part_b")
    pairs = pairs.withColumn("pair", F.xxhash64(*cell, "part", "cell_b", "part_b"))
    self_pair = (F.col("cell") == F.col("cell_b")) & (F.col("part") == F.col("part_b"))
    first = pairs.select(*cell, "part", "pair", F.when(self_pair, -1).otherwise(0).alias("side"))
    second = pairs.filter(~self_pair).select("label", "dims", F.col("cell_b").alias("cell"), F.col("part_b").alias("part"), "pair", F.lit(1).alias("side"))
    met = placed.join(first.union(second), [*cell, "part"]).select("pair", "side", "key", "copies", "vec")
    found = stored(met.groupBy("pair").applyInPandas(_count_links(cosine, window, least_collisions(cosine, window=window)), "key long, other long, n long"), "links")
    links = found.filter("n > 0").groupBy("key").agg(F.sum("n").alias("n"))
    roots = stored(connected_components(found.filter("n = 0"), "key", "other"), "roots")
    known = groups.join(links, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = known.groupBy("root").agg(F.min("low_id").alias("component_id"))
    known = known.join(lowest, "root").select("label", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    linked = rows.filter("fit").join(known, ["label", "vec"]).select("vec_id", F.col("n").cast("long").alias("n_links"), "component_id")
    alone = rows.filter("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
