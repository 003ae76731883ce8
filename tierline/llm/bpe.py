"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern; each match is encoded on its own.
Inside a match the tokens form a linked list over byte positions.  Adjacent
pairs that the vocabulary can merge wait in one bucket per merge rank; a
two-level bitmap marks the buckets in use, and find-first-set on root and
leaf gives the lowest rank without a search.  Entries whose pair has changed
since are stale and skipped when met.  Work per merge does not depend on the
length, so a match of a million bytes costs a million times one of one byte.

Ranks of short matches are kept in two tables of bounded size per Python
worker: when the newer is full it becomes the older, whose entries move to the
newer when met again, so frequent matches stay.
The vocabulary is read from ``path`` on each worker and never copied.

Defined results: a null text encodes as the empty text, to no ids and empty
bytes.  Texts are read whole.  Ids come as a binary column of little-endian
unsigned 32-bit integers; other columns pass through, result columns replace
columns of the same names.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import bounded_batches

#: Matches kept with their ids per worker, in each of two generations, and the
#: longest kept (characters).
CACHE_ENTRIES, CACHE_CHARS = 400_000, 32
#: Ids that are decoded at once.
DECODED = 1 << 16
_LEAF_BITS = 8
_LEAF_MASK = (1 << _LEAF_BITS) - 1


class RankQueue:
    """Positions by rank; ``pop`` gives the lowest rank, leftmost position.
    A bucket (a heap of positions) for each rank in use, a bit for it in its
    leaf, and a bit for each leaf in use in the root."""

    def __init__(self, ranks: int):
        self.root = 0
        self.leaves = [0] * ((ranks >> _LEAF_BITS) + 1)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        leaf = rank >> _LEAF_BITS
        self.leaves[leaf] |= 1 << (rank & _LEAF_MASK)
        self.root |= 1 << leaf

    def pop(self) -> tuple[int, int]:
        in_root = self.root & -self.root
        leaf = in_root.bit_length() - 1
        bits = self.leaves[leaf]
        in_leaf = bits & -bits
        rank = (leaf << _LEAF_BITS) + in_leaf.bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.leaves[leaf] = bits ^ in_leaf
            if bits == in_leaf:
                self.root ^= in_root
        return rank, position


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values()))
        bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        # all tokens end to end, and where each starts
        self.joined = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.sizes = np.array([len(x) for x in bytes_of])
        self.starts = np.cumsum(self.sizes) - self.sizes
        # ranks of single bytes, and of two bytes by both values (-1: none)
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}    # the generation before; what is met again moves over

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))          # end of the token that starts here
        before = list(range(-1, n))          # start of the token that ends here
        waiting = [-1] * n                   # rank of the pair that starts here
        # the queue's steps are written out here: a call each would cost as much as they do
        buckets, leaves, root = self.queue.buckets, self.queue.leaves, 0
        fresh = []                           # pairs to push: rank, start
        single, pairs = self.bytes, self.pairs
        token = [single[b] for b in piece]   # id of the token that starts here
        for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False)):
            rank = pairs[a << 8 | b]
            if rank >= 0:
                waiting[i] = rank
                if rank in buckets:
                    buckets[rank].append(i)  # starts ascend: still a heap
                else:
                    buckets[rank] = [i]
                    leaves[rank >> _LEAF_BITS] |= 1 << (rank & _LEAF_MASK)
                    root |= 1 << (rank >> _LEAF_BITS)
        while root:
            # the lowest rank in use, its leftmost position
            in_root = root & -root
            leaf = in_root.bit_length() - 1
            bits = leaves[leaf]
            in_leaf = bits & -bits
            rank = (leaf << _LEAF_BITS) + in_leaf.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                bits ^= in_leaf
                leaves[leaf] = bits
                if not bits:
                    root ^= in_root
            if waiting[i] != rank:
                continue                     # stale
            j = end[i]
            k = end[j]
            end[i] = k
            token[i] = rank
            waiting[j] = waiting[i] = -1
            if k < n:
                before[k] = i
                rank = rank_of(piece[i:end[k]])
                if rank is not None:
                    waiting[i] = rank
                    fresh.append((rank, i))
            p = before[i]
            if p >= 0:
                rank = rank_of(piece[p:k])
                if rank is None:
                    waiting[p] = -1
                else:
                    waiting[p] = rank
                    fresh.append((rank, p))
            for rank, i in fresh:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    leaves[rank >> _LEAF_BITS] |= 1 << (rank & _LEAF_MASK)
                    root |= 1 << (rank >> _LEAF_BITS)
            fresh.clear()
        ids, i = [], 0
        while i < n:
            ids.append(token[i])
            i = end[i]
        if -1 in ids:
            raise KeyError("a byte has no rank")
        return ids

    def _ids(self, match: str) -> bytes:
        packed = self.older.get(match)
        if packed is None:
            ids = self.merge(match.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= CACHE_CHARS:
            if len(self.kept) >= CACHE_ENTRIES:
                self.older = self.kept.copy()
                self.kept.clear()            # ``encode`` holds this table
            self.kept[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        kept, ids = self.kept, self._ids
        return b"".join([kept.get(m) or ids(m) for m in self.find(text)])

    def decode(self, ids: bytes) -> bytes:
        """One gather over the joined tokens; long texts in steps."""
        ids, out = np.frombuffer(ids, "<u4"), []
        for lo in range(0, len(ids), DECODED):
            own = ids[lo:lo + DECODED]
            sizes = self.sizes[own]
            end = np.cumsum(sizes)
            out.append(self.joined[np.repeat(self.starts[own] - end + sizes, sizes) + np.arange(end[-1])].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file (base64 token, space, rank per line)."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return Tokenizer(ranks, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of every whole text, packed."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path, pattern)
        for texts in batches:
            yield pd.Series([t.encode(x) for x in texts], dtype=object)

    return bounded_batches(df).withColumn(out, packed(F.coalesce(F.col(text_col), F.lit(""))))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the packed ids stand for."""

    @F.pandas_udf("binary")
    def unpacked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path, pattern)
        for ids in batches:
            yield pd.Series([t.decode(x) for x in ids], dtype=object)

    return bounded_batches(df).withColumn(out, unpacked(F.coalesce(F.col(ids_col), F.lit(b""))))


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids",
               decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of every whole text and the bytes decoded from them,
    by one Python worker a task (one table in memory) instead of two."""

    @F.pandas_udf("struct<ids:binary,decoded:binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = tokenizer(path, pattern)
        for texts in batches:
            packed = [t.encode(x) for x in texts]
            yield pd.DataFrame({"ids": packed, "decoded": [t.decode(x) for x in packed]})

    coded = bounded_batches(df).withColumn("__both", both(F.coalesce(F.col(text_col), F.lit(""))))
    return coded.withColumns({ids: F.col("__both.ids"), decoded: F.col("__both.decoded")}).drop("__both")
