"""Prefix trie of conversations in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns.  ``placed`` gives each turn its
place in its conversation, ``spliced`` rebuilds conversations from the head of
another one and their own tail, ``trie`` returns the nodes with counts.

Prefix digests are sums of digests of (depth, turn) in three lanes of 48 bits,
so that a running sum gives every prefix of a conversation, in chunks that are
added up in two levels: no conversation is too long for a task.

Conversations that are equal throughout are worked on once, with their number.
Subtrees of at most ``LIGHT_ROWS`` turns are dealt to shards.  In a shard the
distinct prefix digests are enumerated, a minimal perfect hash gives each a
slot (a slot keeps the whole digest; any difference makes another seed), the
counts are scattered into flat arrays over the slots, and children, leaves and
savings are accumulated through the array of parent slots from the deepest
nodes up.  Nodes above these subtrees, which may hold any part of all rows,
get their sums from their members' turns by aggregates: what is found below
is counted at one member of each subtree, its smallest.

Defined results: rows without a conversation id take no part; null roles and
texts are empty; turns are ordered with null first, equal turns by role, then
text, and repeated rows are turns of their own.  Without conversations there
are no nodes, not even the root.  Texts are read whole.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.llm.common import mix, shuffle_partitions, staged

#: Most turns below a node whose subtree one task works on, mean turns of a
#: shard, turns of a conversation that one task adds up, ids in one text.
LIGHT_ROWS, SHARD_ROWS, CHUNK, ENDS = 1024, 1024, 4096, 4096
_MASK = (1 << 48) - 1
_P, _Q = ["p0", "p1", "p2"], ["q0", "q1", "q2"]


def placed(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), len, digest (of role and text) and bytes of the text,
    for each turn.  Rows are sorted over all tasks, so one conversation may
    take any number of them; what stands before a task's first row of a
    conversation is added up over tasks."""
    clean = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = ("conv", "turn", "role", "text")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = staged(clean.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).select(
        "conv", F.unhex(digest).alias("digest"), F.octet_length("text").cast("long").alias("bytes"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    every = Window.partitionBy("conv")
    starts = (rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("len", F.sum("n").over(every)))
    return staged(rows.join(starts, ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "len", "digest", "bytes"), "turns-placed")


def spliced(turns: DataFrame, base, head, most_head: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth from 1, len, digest, bytes) and conversations (conv,
    len) after each conversation c took the first ``head(c)`` turns of
    conversation ``base(c)`` (fewer if it has fewer, none if it is absent) in
    place of as many of its own.  ``head`` is at most ``most_head``."""
    lens = turns.where("pos = 0").select("conv", "len")
    conv = F.col("conv")
    info = (lens.withColumns({"base": base(conv), "head": head(conv)})
            .join(lens.select(F.col("conv").alias("base"), F.col("len").alias("base_len")), "base", "left")
            .withColumn("taken", F.least("head", F.coalesce("base_len", F.lit(0))))
            .select("conv", "base", "head", (F.col("taken") + F.greatest(F.col("len") - F.col("head"), F.lit(0))).alias("new_len"), "taken"))
    info = staged(info, "conversations")
    own = (turns.withColumn("h", head(conv)).where("pos >= h")
           .join(info.select("conv", "taken", "new_len"), "conv")
           .select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), F.col("new_len").alias("len"), "digest", "bytes"))
    heads = (turns.where(F.col("pos") < most_head).select(F.col("conv").alias("base"), "pos", "digest", "bytes")
             .join(info, "base").where("pos < head")
             .select("conv", (F.col("pos") + 1).alias("depth"), F.col("new_len").alias("len"), "digest", "bytes"))
    return own.unionByName(heads), info.select("conv", F.col("new_len").alias("len"))


def _running(df: DataFrame, cols: list[str], mask: int | None = None, descending: bool = False) -> DataFrame:
    """``df`` with ``<col>_run``: sums over a conversation's turns up to each
    depth (or from it down).  Two levels: inside chunks, and over chunks."""
    df = df.withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK))
    order = (F.col("depth").desc(), F.col("chunk").desc()) if descending else (F.col("depth"), F.col("chunk"))
    inside = Window.partitionBy("conv", "chunk").orderBy(order[0]).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("conv").orderBy(order[1]).rowsBetween(Window.unboundedPreceding, -1)
    before = df.where(F.col("len") > CHUNK).groupBy("conv", "chunk").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in cols])

    def offset(c):
        total = F.coalesce(F.sum(c).over(over), F.lit(0))
        return (F.pmod(total, F.lit(mask + 1).cast("decimal(38,0)")) if mask else total).cast("long").alias(f"{c}_before")

    before = before.select("conv", "chunk", *[offset(c) for c in cols])
    out = df.join(before, ["conv", "chunk"], "left")
    for c in cols:
        run = F.sum(c).over(inside) + F.coalesce(f"{c}_before", F.lit(0))
        out = out.withColumn(f"{c}_run", run.bitwiseAND(F.lit(mask)) if mask else run)
    return out.drop("chunk", *[f"{c}_before" for c in cols])


def _paths(turns: DataFrame) -> DataFrame:
    """Turns with the digest of the prefix that ends there (p) and of the one
    before (q)."""
    own = F.sha2(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(b":"), F.col("digest")), 256)
    lanes = turns.withColumn("hex", own)
    for k in range(3):
        lanes = lanes.withColumn(f"t{k}", F.conv(F.substring("hex", 1 + 12 * k, 12), 16, 10).cast("long"))
    lanes = _running(lanes.drop("hex", "digest"), ["t0", "t1", "t2"], _MASK)
    p = [F.col(f"t{k}_run").alias(f"p{k}") for k in range(3)]
    q = [(F.col(f"t{k}_run") - F.col(f"t{k}")).bitwiseAND(F.lit(_MASK)).alias(f"q{k}") for k in range(3)]
    return lanes.select("conv", "depth", "len", "bytes", *p, *q)


class PerfectHash:
    """Distinct 64-bit keys to the slots 0 to n - 1, each its own.  Level by
    level the keys that meet no other in a bitmap of twice their number get
    the rank of their bit; the rest go on to the next level."""

    def __init__(self, keys: np.ndarray, seed: int = 0):
        self.levels, self.n, level = [], len(keys), 0
        base = 0
        while len(keys):
            size = 2 * len(keys)
            salt = np.uint64((seed * 1009 + level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            at = mix(keys ^ salt) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append((salt, np.uint64(size), alone, base - 1 + np.cumsum(alone)))
            base += int(alone.sum())
            keys, level = keys[~alone[at.astype(np.int64)]], level + 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key (of a key that was not given: any slot or -1)."""
        out, todo = np.full(len(keys), -1), np.arange(len(keys))
        for salt, size, alone, rank in self.levels:
            at = (mix(keys[todo] ^ salt) % size).astype(np.int64)
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class NodeTable:
    """Slots of digests (rows of three lanes), verified lane by lane."""

    def __init__(self, digests: np.ndarray):
        for seed in range(64):
            self.seed = seed
            keys = self._keys(digests)
            self.hash = PerfectHash(np.unique(keys), seed)
            slot = self.hash.slots(keys)
            self.kept = np.empty((self.hash.n, 3), np.int64)
            self.kept[slot] = digests
            if (self.kept[slot] == digests).all():
                self.slot_of_rows = slot
                return
        raise RuntimeError("no seed tells all digests apart")

    def _keys(self, digests: np.ndarray) -> np.ndarray:
        d = digests.astype(np.uint64)
        return mix(mix(d[:, 0] + np.uint64(self.seed)) ^ mix(d[:, 1] << np.uint64(16)) + d[:, 2])

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slots of digests that all must be in the table."""
        slot = self.hash.slots(self._keys(digests))
        if len(slot) and not (self.kept[slot] == digests).all():
            raise RuntimeError("a parent is missing from its shard")
        return slot


_NODE = ("p0 long, p1 long, p2 long, q0 long, q1 long, q2 long, depth long, conv_id long, parent_conv_id long, top boolean, "
         "n_convs long, n_children long, n_leaves long, saved_tokens long")


def shard_nodes(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of whole subtrees from their members' turns."""
    table = NodeTable(rows[_P].to_numpy())
    slot, n = table.slot_of_rows, table.hash.n
    depth, size, top = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    depth[slot], size[slot], top[slot] = rows["depth"], rows["bytes"], rows["depth"] == rows["top_depth"]
    before = np.zeros((n, 3), np.int64)
    before[slot] = rows[_Q].to_numpy()
    convs, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    np.add.at(convs, slot, rows["copies"].to_numpy())
    np.minimum.at(least, slot, rows["conv"].to_numpy())
    parent = np.full(n, -1)
    parent[~top] = table.slots(before[~top])
    children = np.bincount(parent[~top], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (convs - 1) * size
    order = np.argsort(-depth, kind="stable")
    order = order[~top[order]]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    out = {c: table.kept[:, k] for k, c in enumerate(_P)} | {c: before[:, k] for k, c in enumerate(_Q)}
    return pd.DataFrame(out | {
        "depth": depth, "conv_id": least, "parent_conv_id": pd.array(np.where(top, 0, least[parent]), "Int64"), "top": top,
        "n_convs": convs, "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def _ends(full: DataFrame) -> DataFrame:
    """p, ends_sha256: ids that end at a node, in order.  Ids are put into
    texts by blocks of consecutive numbers; the texts of a node are hashed one
    after the other and never held together."""
    block = F.floor(F.col("conv") / ENDS)
    texts = (full.groupBy(*_P, block.alias("block"))
             .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))

    def frame(done: list[tuple]) -> pd.DataFrame:
        lanes = {c: np.array([d[k] for d in done], np.int64) for k, c in enumerate(_P)}
        return pd.DataFrame(lanes | {"ends_sha256": pd.Series([d[3] for d in done], dtype=object)})

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, done = None, None, []
        for b in batches:
            for *key, ids in zip(*[b[c].tolist() for c in _P], b["ids"].tolist(), strict=True):
                if key != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield frame(done)
            done = []
        if node:
            yield frame([(*node, state.hexdigest())])

    return (texts.repartition(shuffle_partitions(full.sparkSession), *_P).sortWithinPartitions(*_P, "block")
            .select(*_P, "ids").mapInPandas(digests, "p0 long, p1 long, p2 long, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (conv, depth from 1, len, digest,
    bytes); ``convs`` (conv, len) names all conversations, also those without
    turns.  Per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    zero = [F.lit(0).cast("long").alias(c) for c in _P]
    paths = staged(_paths(turns), "paths")
    full = staged(paths.where("depth = len").select("conv", *_P).unionByName(convs.where("len = 0").select("conv", *zero)), "ends")
    copies = full.groupBy(*_P).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    mine = paths.join(copies.select("conv", "copies"), "conv")
    nodes = mine.groupBy(*_P).agg(F.sum("copies").alias("n_convs"), F.min("conv").alias("first"),
                                  F.sum(F.col("len") - F.col("depth") + 1).alias("below"))
    rows = staged(mine.join(nodes, _P), "members")
    light, heavy = rows.where(F.col("below") <= LIGHT_ROWS), rows.where(F.col("below") > LIGHT_ROWS)

    shards = max(1, math.ceil(light.count() / SHARD_ROWS))
    tops = light.groupBy("conv").agg(F.min(F.struct("depth", *_P)).alias("t"))
    tops = tops.select("conv", F.col("t.depth").alias("top_depth"), F.pmod(F.xxhash64(*[F.col(f"t.{c}") for c in _P]), F.lit(shards)).alias("shard"))
    low = staged(light.select("conv", "depth", "bytes", "copies", *_P, *_Q).join(tops, "conv")
                 .groupBy("shard").applyInPandas(shard_nodes, _NODE), "low-nodes")

    found = low.where("top").select(F.col("conv_id").alias("conv"), "n_leaves", "saved_tokens")
    own = F.when(F.col("conv") == F.col("first"), (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0)
    high = (_running(heavy.withColumn("own", own), ["own"], descending=True).join(found, "conv", "left")
            .groupBy(*_P).agg(*[F.first(c).alias(c) for c in (*_Q, "depth", "n_convs")], F.min("conv").alias("conv_id"),
                              F.sum(F.coalesce("n_leaves", F.lit(0))).alias("n_leaves"),
                              F.sum(F.col("own_run") + F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens")))
    high = staged(high, "high-nodes")
    upper = high.select(*_P, *_Q, "depth", "conv_id").unionByName(low.where("top").select(*_P, *_Q, "depth", "conv_id"))
    parents = high.select(*[F.col(p).alias(q) for p, q in zip(_P, _Q, strict=True)], F.col("conv_id").alias("parent"))
    children = upper.groupBy(*_Q).agg(F.count("*").alias("n_children"))
    children = children.select(*[F.col(q).alias(p) for p, q in zip(_P, _Q, strict=True)], "n_children")

    total = convs.agg(F.min("conv"), F.count("*")).first()
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if not total[1]:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in result) + ", ends_sha256 string")
    above = F.when(F.col("depth") == 1, F.lit(total[0])).otherwise(F.col("parent")).alias("parent_conv_id")
    high = high.join(children, _P, "left").join(parents, _Q, "left").select(*_P, *[above if c == "parent_conv_id" else c for c in result])
    first = low.where("top").join(parents, _Q, "left").select(*_P, *[above if c == "parent_conv_id" else c for c in result])
    rest = low.where("not top").select(*_P, *result)
    below = high.unionByName(first).unionByName(rest)
    root = (high.unionByName(first).where("depth = 1")
            .agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
                 F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
            .select(*zero, F.lit(total[0]).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
                    F.lit(total[1]).alias("n_convs"), "n_children", "n_leaves", "saved_tokens"))
    return (below.unionByName(root).join(_ends(full), _P, "left")
            .select(*result, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
