"""Substring dedup: fixed-block anchors.

A repeat is a window of ``width`` words whose word sequence also starts
anywhere else, in the same text or another.  Blocks of ``(width + 1) // 2``
words at fixed, non-overlapping places of every text are the index: each
window covers at least one whole block.

1. Every rolling window of block length probes the index.  Hashes of probes
   and blocks meet by hash bucket; a probe whose hash is a block's and occurs
   at least twice is an anchor.
2. Anchors are extended: every window that covers an anchor is hashed whole,
   and those whose hash occurs at least twice are repeats.  Runs of repeats
   are the maximal exact repeats.
3. Each text drops the words its repeats cover.

Steps 1 and 2 send packed hash lists through one shuffle by hash bucket each
and get back, per text, the hashes that count.  A task first looks at its own
slice of texts: a hash found twice there is known to repeat, so it is sent
once, without its places, and answered on the spot; a text that occurs twice
there is repeated as a whole.  A passage or text that a third of all documents
share thus costs one entry per slice, not one per document.  Anchors use 48
hash bits (a false anchor only means one more window to test), repeats 64.

Defined results: null and empty texts have no words; texts shorter than a
window lose nothing.  Texts are read whole; a very long one in overlapping
stretches.  Repeated rows repeat each other.  Rows are joined by a hash of the
text, so null and repeated ids are no matter.  Other columns pass through; the
result columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import bounded_batches, pieces, shuffle_partitions, slices, staged, window_hashes, word_hashes

WIDTH = 35
_STRETCH = 1 << 18
_ANCHOR_BYTES, _REPEAT_BYTES = 6, 8
_ASK = ("bucket int, keys binary, counts binary, hashes binary, blocks binary, known binary, "
        "told_keys binary, told_counts binary, told_hashes binary, wholes binary")
_TOLD = "target int, keys binary, counts binary, hashes binary, wholes binary"
_MET = "key long, hashes binary, whole boolean"


def pack(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers in ``width`` bytes each."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def block_size(width: int) -> int:
    return (width + 1) // 2


def stretches(words: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a text's words so that each window lies in exactly one part."""
    for at in range(0, max(0, len(words) - width + 1), _STRETCH):
        yield at, words[at:at + _STRETCH + width - 1]


def _low_bits(h: np.ndarray, width: int) -> np.ndarray:
    return h & np.uint64((1 << 8 * width) - 1)


@dataclass
class _Slice:
    """What a task sends about a slice of texts."""

    buckets: int
    bytes: int
    keys: list[int] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    blocks: list[np.ndarray] = field(default_factory=list)
    whole: list[bool] = field(default_factory=list)

    def add(self, key: int, hashes: list[np.ndarray], blocks: list[np.ndarray], whole: bool) -> None:
        for h in hashes:
            self.hashes.append(h)
            self.rows.append(np.full(len(h), len(self.keys), np.int64))
        self.blocks += blocks
        self.keys.append(key)
        self.whole.append(whole)

    def sent(self, turn: int) -> pd.DataFrame:
        """Rows of _ASK: the lists of each bucket; the slice's own answers go
        with bucket ``turn``."""
        if not self.keys:
            return pd.DataFrame(columns=[c.split()[0] for c in _ASK.split(", ")])
        keys, whole = np.array(self.keys, np.int64), np.array(self.whole)
        empty = np.empty(0, np.uint64)
        hashes = np.concatenate(self.hashes) if self.hashes else empty
        rows = np.concatenate(self.rows) if self.rows else np.empty(0, np.int64)
        blocks = np.unique(np.concatenate(self.blocks)) if self.blocks else empty
        _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
        twice = (count[back] > 1) | whole[rows]
        known = np.unique(hashes[twice])
        told = twice & ~whole[rows]
        out = {c.split()[0]: [b""] * self.buckets for c in _ASK.split(", ")}
        out["bucket"] = list(range(self.buckets))
        for b, (k, c, h) in enumerate(runs(hashes[~twice], rows[~twice], keys, self.buckets)):
            out["keys"][b], out["counts"][b], out["hashes"][b] = k.tobytes(), c.tobytes(), pack(h, self.bytes)
        for name, values in (("blocks", blocks), ("known", known)):
            for b, part in enumerate(_deal(values, self.buckets)):
                out[name][b] = pack(values[part], self.bytes)
        turn %= self.buckets
        (k, c, h), = runs(hashes[told], rows[told], keys, 1)
        out["told_keys"][turn], out["told_counts"][turn], out["told_hashes"][turn] = k.tobytes(), c.tobytes(), pack(h, self.bytes)
        out["wholes"][turn] = keys[whole].tobytes()
        return pd.DataFrame(out)


def _deal(values: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Indexes of the values of each bucket, in order."""
    if buckets == 1:
        return [np.arange(len(values))]
    own = (values % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(buckets + 1))
    return [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def runs(values: np.ndarray, rows: np.ndarray, keys: np.ndarray, buckets: int):
    """For each bucket: the keys, how many values each has, the values.
    ``keys`` of None: the rows are the keys."""
    for part in _deal(values, buckets):
        r = rows[part]
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(r))).astype(np.uint32)
        yield r[starts] if keys is None else keys[r[starts]], counts, values[part]


def _joined(b: pd.DataFrame, name: str, kind) -> np.ndarray:
    raw = b"".join(b[name])
    return unpack(raw, kind) if isinstance(kind, int) else np.frombuffer(raw, kind)


def _sorted_pairs(keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, hash) pairs by key, then hash."""
    order = np.lexsort((hashes, keys))
    k, h = keys[order], hashes[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    return k[new], h[new]


def _answer(anchors: bool, width: int, targets: int):
    """Per bucket: which hashes count, packed for the texts that hold them.
    Texts are dealt to targets by key, so rows follow buckets and targets and
    not texts times buckets."""

    def told(b: pd.DataFrame) -> pd.DataFrame:
        hashes = _joined(b, "hashes", width)
        keys = np.repeat(_joined(b, "keys", np.int64), _joined(b, "counts", np.uint32))
        values, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
        counts = count > 1
        if anchors:
            counts &= np.isin(values, _joined(b, "blocks", width))
        counts |= np.isin(values, _joined(b, "known", width))
        hit = counts[back]
        known = np.repeat(_joined(b, "told_keys", np.int64), _joined(b, "told_counts", np.uint32))
        keys, hashes = _sorted_pairs(np.concatenate((keys[hit], known)),
                                     np.concatenate((hashes[hit], _joined(b, "told_hashes", width))))
        wholes = np.unique(_joined(b, "wholes", np.int64))
        out = []
        for target, (part, whole) in enumerate(zip(_deal(keys.view(np.uint64), targets), _deal(wholes.view(np.uint64), targets),
                                                   strict=True)):
            if len(part) or len(whole):
                (k, c, h), = runs(hashes[part], keys[part], None, 1)
                out.append((target, k.tobytes(), c.tobytes(), pack(h, width), wholes[whole].tobytes()))
        return pd.DataFrame(out, columns=["target", "keys", "counts", "hashes", "wholes"])

    return told


def _gather(width: int):
    """Per target: one row for each text with all its hashes that count."""

    def met(b: pd.DataFrame) -> pd.DataFrame:
        keys, hashes = _sorted_pairs(np.repeat(_joined(b, "keys", np.int64), _joined(b, "counts", np.uint32)),
                                     _joined(b, "hashes", width))
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
        rows = {int(keys[x]): pack(hashes[x:y], width) for x, y in zip(cuts, cuts[1:], strict=False)}
        wholes = set(_joined(b, "wholes", np.int64).tolist())
        return pd.DataFrame([(k, rows.get(k, b""), k in wholes) for k in rows.keys() | wholes], columns=["key", "hashes", "whole"])

    return met


def _met(asked: DataFrame, anchors: bool, width: int, name: str) -> DataFrame:
    """key -> its hashes that count, whole; written out."""
    targets = shuffle_partitions(asked.sparkSession)
    told = asked.groupBy("bucket").applyInPandas(_answer(anchors, width, targets), _TOLD)
    return staged(told.groupBy("target").applyInPandas(_gather(width), _MET), name)


def _unique(keys) -> tuple[list[int], dict[int, int]]:
    """First places of the keys of a slice, and how often each occurs."""
    first: dict[int, int] = {}
    times: dict[int, int] = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
        times[k] = times.get(k, 0) + 1
    return list(first.values()), times


def _covering(hit: np.ndarray, block: int, width: int) -> np.ndarray:
    """Windows (by start) that cover a hit block-length window."""
    total = np.concatenate(([0], np.cumsum(hit)))
    reach = width - block + 1
    return total[reach:] > total[:-reach]


def repeats(df: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """key (hash of a text) -> hashes of its repeated windows, whole."""
    buckets, block = shuffle_partitions(df.sparkSession), block_size(width)
    texts = bounded_batches(df).select(F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("t")).where(F.col("t").isNotNull())

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            for lo, hi in slices([len(t) for t in b["t"]]):
                part, keys = b["t"].iloc[lo:hi].tolist(), b["key"].iloc[lo:hi].tolist()
                first, times = _unique(keys)
                out = _Slice(buckets, _ANCHOR_BYTES)
                for i in first:
                    words = word_hashes(part[i])
                    rolled = [_low_bits(window_hashes(w, block), _ANCHOR_BYTES) for _, w in stretches(words, width)]
                    if rolled:
                        out.add(keys[i], rolled, [h[::block] for h in rolled], times[keys[i]] > 1)
                yield out.sent(turn)
                turn += 1

    anchors = _met(texts.mapInPandas(probe, _ASK), True, _ANCHOR_BYTES, "anchors")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = TaskContext.get().partitionId()
        for b in batches:
            for lo, hi in slices([len(t) for t in b["t"]]):
                p = b.iloc[lo:hi]
                part, keys, wholes = p["t"].tolist(), p["key"].tolist(), p["whole"].tolist()
                first, times = _unique(keys)
                out = _Slice(buckets, _REPEAT_BYTES)
                for i in first:
                    words = word_hashes(part[i])
                    whole = bool(wholes[i]) or times[keys[i]] > 1
                    hits = unpack(p["hashes"].iloc[i], _ANCHOR_BYTES)
                    found = []
                    for _, w in stretches(words, width):
                        h = window_hashes(w, width)
                        if not whole:
                            rolled = _low_bits(window_hashes(w, block), _ANCHOR_BYTES)
                            h = h[_covering(np.isin(rolled, hits), block, width)]
                        found.append(h)
                    out.add(keys[i], found, [], whole)
                yield out.sent(turn)
                turn += 1

    asked = texts.join(anchors.hint("merge"), "key").mapInPandas(extend, _ASK)
    return _met(asked, False, _REPEAT_BYTES, "repeats")


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _drop(text: bytes, hashes: np.ndarray, whole: bool, width: int) -> tuple[int, bytes, list[tuple[int, int]]]:
    """Words, kept words joined by a blank, and removed ranges of words."""
    if not whole and not len(hashes):
        kept, n = [], 0
        for piece in pieces(text):
            w = piece.split()
            n += len(w)
            if w:
                kept.append(b" ".join(w))
        return n, b" ".join(kept), []
    words = word_hashes(text)
    mask = np.zeros(len(words) + 1, np.int32)
    for at, w in stretches(words, width):
        starts = at + (np.arange(len(w) - width + 1) if whole else np.flatnonzero(np.isin(window_hashes(w, width), hashes)))
        np.add.at(mask, starts, 1)
        np.add.at(mask, starts + width, -1)
    gone = np.cumsum(mask[:-1]) > 0
    kept, at = [], 0
    for piece in pieces(text):
        w = piece.split()
        keep = [x for x, g in zip(w, gone[at:at + len(w)].tolist(), strict=True) if not g]
        at += len(w)
        if keep:
            kept.append(b" ".join(keep))
    return len(words), b" ".join(kept), _spans(gone)


def dedup(df: DataFrame, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``df`` with n_words, n_removed, kept (the words that stay, joined by
    one blank) and removed (ranges of word numbers, end exclusive)."""
    found = repeats(df, text_col, width).select(F.col("key").alias("__key"), F.col("hashes").alias("__hashes"),
                                                F.col("whole").alias("__whole"))

    @F.pandas_udf("struct<n_words:bigint,kept:string,removed:array<struct<start:bigint,end:bigint>>>")
    def dropped(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, hashes, wholes in batches:
            out = []
            for t, h, w in zip(texts, hashes, wholes, strict=True):
                own = unpack(h or b"", _REPEAT_BYTES)
                n, kept, spans = _drop(t, own, bool(w), width)
                out.append((n, kept.decode("utf-8", "replace"), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(out, columns=["n_words", "kept", "removed"])

    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    r = F.col("__r")
    removed = F.aggregate(r["removed"], F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return (df.withColumn("__key", F.xxhash64(text_col)).join(found.hint("merge"), "__key", "left")
            .withColumn("__r", dropped(text, F.col("__hashes"), F.coalesce("__whole", F.lit(False))))
            .withColumns({"n_words": r["n_words"], "n_removed": removed, "kept": r["kept"], "removed": r["removed"]})
            .drop("__key", "__hashes", "__whole", "__r"))
