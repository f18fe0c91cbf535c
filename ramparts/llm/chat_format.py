"""Chat formatting as a prefix tree.

Conversations that share their first turns share tree nodes. A node is one formatted turn; its name is a
128-bit hash of the conversation up to it, so equal beginnings meet by one aggregation. Nodes are laid out
depth-first (sorted by the names on their path) as one packed token stream: every node once, with the
position id of its first token (tokens before it in its own conversation), the packed interval it fills, the
intervals of its ancestors, which are all it may attend to besides itself, and the interval under the loss
mask. Tokens are the code points of the formatted text; ``position`` and intervals count them.

A conversation is read in turn order as a stream, so its length is no limit; a node's row holds its path.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramparts.llm.common import bounded_batches, stored

START, END = "<|im_start|>", "<|im_end|>"
NO_ID = -(1 << 63)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str | None) -> str:
    """Text in which no control string can stand; ``unescape`` undoes it."""
    return (text or "").replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and where the tokens under the loss mask begin and end (assistant texts)."""
    head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
    learn = len(body) if role == "assistant" else 0
    return f"{head}{body}{END}\n", len(head), len(head) + learn


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, text = _TURN.fullmatch(formatted).groups()
    return unescape(role), unescape(text)


def _steps(batches):
    """Rows sorted by (conv, turn) to one row per turn with the names of its node and path."""
    conv = None
    for pdf in batches:
        out = []
        for key, role, text in zip(pdf["conv"], pdf["role"], pdf["text"]):
            if key != conv:
                conv, chain, path, position, index = key, b"", [], 0, 0
            formatted, low, high = format_turn(role, text)
            chain = hashlib.blake2b(chain + formatted.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            path = [*path, int.from_bytes(chain[:8], "big", signed=True)]
            out.append((conv, index, chain, path, position, formatted, low, high))
            index, position = index + 1, position + len(formatted)
        yield pd.DataFrame(out, columns=["conv", "index", "node", "path", "position", "formatted", "loss_low", "loss_high"])


def _offsets(batches):
    """Tokens before each node inside its range."""
    at = 0
    for pdf in batches:
        size = pdf["formatted"].str.len()
        before = size.cumsum() - size + at
        at += int(size.sum())
        yield pdf.assign(tokens=size, inner=before)


def _ancestors(batches):
    """Rows sorted by (conv, index) to the ancestors' intervals of every node owned by its conversation."""
    conv, spans = None, []
    for pdf in batches:
        nodes, lists = [], []
        for key, owner, node, low, tokens in zip(pdf["conv"], pdf["owner"], pdf["node"], pdf["low"], pdf["tokens"]):
            if key != conv:
                conv, spans = key, []
            if owner == key:
                nodes.append(node)
                lists.append([{"low": a, "high": b} for a, b in spans])
            spans = [*spans, (low, low + tokens)]
        yield pd.DataFrame({"node": nodes, "ancestors": lists})


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted turns with node names, one row per row."""
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.coalesce(F.col(conv_id).cast("long"), F.lit(NO_ID)).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    return rows.mapInPandas(_steps, "conv long, index int, node binary, path array<long>, position long, formatted string, loss_low int, loss_high int")


def pack(turns: DataFrame) -> DataFrame:
    """The packed tree of ``turns_of``: ``node, owner, index, position, formatted, low, high, loss_low, loss_high, ancestors``.

    ``low`` to ``high`` is the node's interval in the stream, ``loss_low`` to ``loss_high`` the part of it under
    the loss mask, ``owner`` the smallest conversation through it.
    """
    spark = turns.sparkSession
    nodes = stored(turns.groupBy("node").agg(F.min("conv").alias("owner"), *(F.first(c).alias(c) for c in ("index", "path", "position", "formatted", "loss_low", "loss_high"))), "nodes")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartitionByRange(ranges, "path").sortWithinPartitions("path").withColumn("range", F.spark_partition_id())
    placed = stored(placed.mapInPandas(_offsets, f"{', '.join(f'{n} {t}' for n, t in placed.dtypes)}, tokens long, inner long").drop("path"), "placed")
    totals = placed.groupBy("range").agg(F.sum("tokens").alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    bases = F.broadcast(totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    tree = placed.join(bases, "range").withColumn("low", F.col("inner") + F.col("base"))
    leaves = turns.groupBy("conv").agg(F.max_by("node", "index").alias("leaf")).groupBy("leaf").agg(F.min("conv").alias("conv"))
    paths = turns.select("conv", "index", "node").join(leaves.select("conv"), "conv").join(tree.select("node", "owner", "low", "tokens"), "node")
    seen = (paths.repartition("conv").sortWithinPartitions("conv", "index").select("conv", "owner", "node", "low", "tokens")
            .mapInPandas(_ancestors, "node binary, ancestors array<struct<low: long, high: long>>"))
    return tree.join(seen, "node").select("node", "owner", "index", "position", "formatted", "low", (F.col("low") + F.col("tokens")).alias("high"),
                                          (F.col("low") + F.col("loss_low")).alias("loss_low"), (F.col("low") + F.col("loss_high")).alias("loss_high"), "ancestors")


def _digests(batches):
    """Packed pieces sorted by (leaf, place) to what each conversation reads as."""
    state = None

    def row():
        leaf, turns, sha, loss, sha_loss, size = state
        return leaf, turns, sha.hexdigest(), loss, sha_loss.hexdigest(), size
    for pdf in batches:
        out = []
        for leaf, formatted, low, loss_low, loss_high in zip(pdf["leaf"], pdf["formatted"], pdf["low"], pdf["loss_low"], pdf["loss_high"]):
            if state is None or leaf != state[0]:
                if state is not None:
                    out.append(row())
                state = [leaf, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(formatted)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            learned = unescape(formatted[loss_low - low:loss_high - low])
            state[3] += len(learned)
            state[4].update(learned.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        yield pd.DataFrame(out, columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    if state is not None:
        yield pd.DataFrame([row()], columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def format_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(tree, members)``: the packed tree, and the leaf node of every conversation.

    Turns go by ``turn``, then role and text (nulls first); repeated rows are turns of their own. A null role or
    text is empty; null ids form one conversation. An empty table gives an empty tree. Other columns are not read.
    """
    turns = stored(turns_of(conversations, conv_id, turn, role, text), "turns")
    members = turns.groupBy("conv").agg(F.max_by("node", "index").alias("leaf"))
    return stored(pack(turns), "tree"), members


def read_back(tree: DataFrame, members: DataFrame) -> DataFrame:
    """Per conversation, what the packed stream holds at the intervals its last node may attend to."""
    leaves = members.select("leaf").distinct().join(tree.select(F.col("node").alias("leaf"), "low", "high", "ancestors"), "leaf")
    spans = leaves.select("leaf", F.explode(F.concat("ancestors", F.array(F.struct("low", "high")))).alias("span"))
    found = spans.select("leaf", F.col("span.low").alias("low")).join(tree.select("low", "formatted", "loss_low", "loss_high"), "low")
    read = (found.select("leaf", "formatted", "low", "loss_low", "loss_high").repartition("leaf").sortWithinPartitions("leaf", "low")
            .mapInPandas(_digests, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
    return members.join(read, "leaf").select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
