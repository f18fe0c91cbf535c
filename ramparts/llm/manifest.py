"""A Merkle manifest of a table: a digest per row, a tree per group, a root, and a proof per row.

Method: cogrouped subtree exchange. The leaves of a group stand in a fixed order and are cut into
superblocks of ``BLOCK`` consecutive ones. Going up, each superblock is reduced to its top in a
task of its own; the tops are cut into superblocks again until one node is left. Going down, the
nodes of a tier and the *outer* row of their superblock (the proof of its top, already known) are
cogrouped by superblock: one function call rebuilds the levels inside, joins inner and outer
siblings to whole proofs and folds them. A call never sees more than ``BLOCK`` nodes and one proof.
The subroots of the groups form one more tree in the same way.

Places come from ``ranked``, which cuts a hot group into ranges, so no task holds a group. The row
itself is read once, in the JVM, and leaves no more than its digests behind.

Defined results: null fields are part of a leaf (``-``), as are empty and very long texts. Rows of one
group with the same id stand in the order of their digests; equal rows get equal leaves and places of
their own. Null ids come first and are never tampered with. A group of one row has its leaf as subroot,
a table with one group its subroot as root; proofs without siblings are the digest of the empty text.
An empty table gives no rows. Columns that are not named as fields are ignored, so clashing ones are safe.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramparts.llm.common import stored
from ramparts.session import ranked

BLOCK_LEVELS = 10
BLOCK = 1 << BLOCK_LEVELS
DIGEST = 32
LEFT, RIGHT, ALONE = b"l", b"r", b"-"
NODES = "grp string, pos long, node binary"
OUTER = "grp string, pos long, path binary, subroot binary, root binary"


def field_bytes(value: Column, text: Column | None = None) -> Column:
    """A field as it enters a leaf: its length in UTF-8 bytes, a colon and itself; null is a dash."""
    text = value.cast("string") if text is None else text
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_bytes(f) for f in fields]), 256))


def _parent(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def _levels(nodes: list[bytes], count: int) -> list[list[bytes]]:
    """``count`` levels above consecutive nodes, themselves first."""
    levels = [nodes]
    for _ in range(count):
        below = levels[-1]
        levels.append([_parent(below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def _height(size: int) -> int:
    """Levels above ``size`` nodes until one is left."""
    return (size - 1).bit_length()


def _steps(levels: list[list[bytes]], at: int) -> bytes:
    """The siblings of a node up to the last level, each with its side."""
    path = []
    for level in levels[:-1]:
        beside = at ^ 1
        path.append(ALONE + bytes(DIGEST) if beside >= len(level) else (LEFT if beside < at else RIGHT) + level[beside])
        at >>= 1
    return b"".join(path)


def _siblings(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    for i in range(0, len(path), DIGEST + 1):
        yield path[i:i + 1], path[i + 1:i + 1 + DIGEST]


def proof_digest(path: bytes) -> bytes:
    return _parent([digest for side, digest in _siblings(path) if side != ALONE])


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a node and its proof lead to."""
    for side, digest in _siblings(path):
        node = _parent([node] if side == ALONE else [digest, node] if side == LEFT else [node, digest])
    return node


def _inside(block: int, count: int) -> int:
    """Levels that a superblock reduces: as many as a full one has, or all levels of a group that fits into one.

    Only the first superblock of a group can be its only one, and it is, unless it is full.
    """
    return BLOCK_LEVELS if block else _height(count)


def _tops(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("pos")
    block = int(frame["block"].iloc[0])
    top = _levels(list(frame["node"]), _inside(block, len(frame)))[-1][0]
    return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "pos": [block], "node": [top]})


def _with_paths(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one superblock with their whole proofs: siblings inside it, then those of its outer row."""
    nodes = nodes.sort_values("pos").reset_index(drop=True)
    levels, above = _levels(list(nodes["node"]), _inside(int(nodes["block"].iloc[0]), len(nodes))), outer.iloc[0]
    return nodes.assign(path=[_steps(levels, at) + above["path"] for at in range(len(nodes))], subroot=above["subroot"], root=above["root"])


def _next_outer(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    return _with_paths(nodes, outer)[["grp", "pos", "path", "subroot", "root"]]


def _finished(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The leaves of one superblock with the digest of their proofs and the root they fold to."""
    whole = _with_paths(nodes, outer)
    shown = [node if other is None else other for node, other in zip(whole["node"], whole["tampered"])]
    return whole.assign(proof=[proof_digest(p) for p in whole["path"]], folded=[fold(n, p) for n, p in zip(shown, whole["path"])])[
        ["id", "node", "subroot", "root", "proof", "folded"]]


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", BLOCK_LEVELS))


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """All tiers, each the tops of the superblocks of the one before; in the last one every group has one node."""
    tiers = [_blocked(nodes)]
    while (tiers[-1].agg(F.max("pos").alias("m")).first()["m"] or 0) > 0:
        tops = tiers[-1].select("grp", "block", "pos", "node").groupBy("grp", "block").applyInPandas(_tops, NODES)
        tiers.append(_blocked(stored(tops, "tops")))
    return tiers


def _exchange(tier: DataFrame, outer: DataFrame, finish, schema: str) -> DataFrame:
    return tier.groupBy("grp", "block").cogroup(outer.groupBy("grp", "pos")).applyInPandas(finish, schema)


def _descend(tiers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """Outer rows of the superblocks of the lowest tier, from those of the last tier's nodes."""
    for tier in reversed(tiers[1:-1]):
        outer = stored(_exchange(tier.select("grp", "block", "pos", "node"), outer, _next_outer, OUTER), "outer")
    return outer


def _roots(tops: DataFrame) -> DataFrame:
    """The outer row of every group's last node: its proof up to the root of all groups."""
    named = stored(ranked(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["grp"], [F.col("name")]).select(
        "grp", "name", (F.col("rank") - 1).alias("pos"), "node"), "subroots")
    tiers = _climb(named.select("grp", "pos", "node"))
    top = tiers[-1].select("grp", "pos", F.lit(b"").alias("path"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    if len(tiers) > 1:
        outer = _exchange(tiers[0], _descend(tiers, top), _next_outer, OUTER)
    else:
        outer = top
    joined = named.join(outer.select("pos", "path", "root"), "pos")
    return stored(joined.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root"), "outer")


def manifest(rows: DataFrame, fields: list[str], group_col: str, id_col: str, tampered: dict[str, Column] | None = None,
             is_tampered: Column | None = None) -> DataFrame:
    """One row per row of ``rows``: its id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    Where ``is_tampered`` holds, the leaf that is folded is made from the values in ``tampered`` in place
    of the fields of those names; the tree is always built from the rows as they are.
    """
    own = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([(tampered or {}).get(f, F.col(f)) for f in fields]) if tampered else F.lit(None).cast("binary")
    # a null group sorts before all names, the empty one included
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col)))
    leaves = stored(rows.select(group.alias("grp"), F.col(id_col).alias("id"), own.alias("node"),
                                F.when(F.coalesce(is_tampered if is_tampered is not None else F.lit(False), F.lit(False)), other).alias("tampered")), "leaves")
    placed = stored(ranked(leaves, ["grp"], [F.col("id").asc_nulls_first(), F.col("node")]).select(
        "grp", (F.col("rank") - 1).alias("pos"), "id", "node", "tampered"), "places")
    tiers = _climb(placed)
    outer = _descend(tiers, _roots(tiers[-1].select("grp", "node")))
    kind = placed.schema["id"].dataType.simpleString()
    done = _exchange(tiers[0], outer, _finished, f"id {kind}, node binary, subroot binary, root binary, proof binary, folded binary")

    def shown(name: str) -> Column:
        return F.lower(F.hex(name))
    return done.select(F.col("id").alias(id_col), shown("node").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
                       shown("proof").alias("proof_sha256"), shown("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
