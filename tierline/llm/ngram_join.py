"""N-gram Jaccard join: blocked sparse matrix product of documents by n-grams.

A document is the set of its distinct word n-grams; two documents link when
``den * intersection >= num * union``.  Equal sets are one class, and only
classes are compared.

1. Columns.  Classes that share no n-gram have overlap 0, so n-grams of one
   class are only counted.  Hash lists meet by bucket, and every class gets
   back its shared n-grams with their numbers of classes.  N-grams in at least
   ``HOT_SHARE`` of all texts are found by a pass before it (a task sends the
   n-grams frequent in its slice; whatever is frequent overall is frequent in
   some slice) and are not sent: at most 1 / HOT_SHARE x the mean set size
   exist, a bound that does not follow the number of documents.
2. Rows.  The rarest-first prefix of ``n - ceil(n * num / den) + 1`` n-grams
   must share an n-gram with any partner's prefix.  Classes whose prefix has
   only n-grams of their own are done.  The others fall into families, the
   components of classes that share a prefix n-gram.
3. Product.  A family is cut into blocks of rows; each pair of blocks is one
   tile.  A tile multiplies its rows' incidence in blocks of columns, rarest
   first, adds up overlaps, and after each block discards pairs whose overlap
   plus what is left cannot reach the bound that follows from their sizes.
   Small families share a tile.  A tile returns a spanning forest of its
   links, never the pairs.
4. Components of the forests' edges.

Defined results: null and empty texts, and texts without words, are empty sets
and linked with nothing; a text of fewer than ``n`` words is one n-gram, its
whole sequence.  Rows that share a document id are rows of their own with that
id; a null id takes part but is no component's id unless all its rows have
none.  A-Z are lower-cased.  Hashes have 64 bits.  Other columns do not take
part: results are by document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import bounded_batches, shuffle_partitions, slices, staged, window_hashes, word_hashes
from tierline.llm.components import components
from tierline.llm.substring_dedup import _deal

HOT_SHARE = 1 / 1000
#: N-grams in fewer classes than this are never hot (small inputs).
HOT_LEAST = 256
TILE_ROWS, TILE_BYTES = 1024, 8 << 20
#: Most hashes of a bucket, of which a task holds one at a time, and of a range
#: of it that is sorted at once.
BUCKET_BYTES, RANGE_BYTES = 16 << 20, 2 << 20
_COLUMNS = 4096
_HOT = np.uint32(0xFFFFFFFF)

_ASK = ("bucket int, keys binary, sizes binary, counts binary, hashes binary, hot_keys binary, hot_sizes binary, "
        "hot_counts binary, hot_hashes binary, doc_rows binary, doc_ids binary, doc_null binary")


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = word_hashes(text.lower())
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(n, len(words))))


def _class(hashes: np.ndarray) -> int:
    """Key of a set, as a signed 64-bit integer."""
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def _sets(b: pd.DataFrame, n: int) -> Iterator[tuple[list, list[np.ndarray], list[int]]]:
    """Slices of a batch: ids, sets, class keys."""
    for lo, hi in slices([len(t) for t in b["t"]]):
        sets = [shingles(t, n) for t in b["t"].iloc[lo:hi]]
        yield b["id"].iloc[lo:hi].tolist(), sets, [_class(s) for s in sets]


def _distinct(sets, keys) -> list[int]:
    seen: dict[int, int] = {}
    for i, k in enumerate(keys):
        if len(sets[i]):
            seen.setdefault(k, i)
    return list(seen.values())


def _hot(texts: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """N-grams in about HOT_SHARE of all texts or more, sorted; and how many
    n-grams the tasks will send, sets that are equal within a slice once."""

    def frequent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, sets, keys in _sets(b, n):
                own = _distinct(sets, keys)
                yield pd.DataFrame({"h": [0, 1], "n": [len(own), sum(len(sets[i]) for i in own)], "all": [True, True]})
                if own:
                    h, count = np.unique(np.concatenate([sets[i] for i in own]), return_counts=True)
                    m = count >= max(2, HOT_SHARE * len(own))
                    yield pd.DataFrame({"h": h[m].view(np.int64), "n": count[m], "all": False})

    found = staged(texts.mapInPandas(frequent, "h long, n long, all boolean").groupBy("all", "h").agg(F.sum("n").alias("n")), "hot")
    totals = {r["h"]: r["n"] for r in found.where("all").collect()}         # two rows
    total = totals.get(0, 0)
    rows = found.where(~F.col("all") & (F.col("n") >= max(HOT_LEAST, HOT_SHARE * total))).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).view(np.uint64)), totals.get(1, 0)


def _runs(hashes, rows, keys, sizes, buckets):
    for part in _deal(hashes, buckets):
        r = rows[part]
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.empty(0, np.int64)
        first = r[starts]
        yield keys[first], sizes[first], np.diff(np.append(starts, len(r))).astype(np.uint32), hashes[part]


def _shared(keys: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
    """Of (class, size, n-gram) rows those whose n-gram two classes have, each
    once, with the number of its classes."""
    order = np.lexsort((keys, hashes))
    keys, sizes, hashes = keys[order], sizes[order], hashes[order]
    new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])))
    keys, sizes, hashes = keys[new], sizes[new], hashes[new]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    times = np.diff(np.append(first, len(hashes)))
    df = np.repeat(times, times).astype(np.uint32)
    m = df > 1
    return keys[m], sizes[m], hashes[m], df[m]


def _columns(texts: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """documents (id, key, n) and active classes (key, n, prefix, own)."""
    spark = texts.sparkSession
    hot, sent = _hot(texts, n)
    buckets = max(shuffle_partitions(spark), -(-8 * sent // BUCKET_BYTES))
    shared = spark.sparkContext.broadcast(hot)                 # bounded, see the module's text

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, turn = shared.value, 0
        for b in batches:
            for ids, sets, keys in _sets(b, n):
                own = _distinct(sets, keys)
                empty = np.empty(0, np.uint64)
                hashes = np.concatenate([sets[i] for i in own]) if own else empty
                rows = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
                k = np.array([keys[i] for i in own], np.int64)
                size = np.array([len(sets[i]) for i in own], np.uint32)
                is_hot = np.isin(hashes, hot)
                out = {c.split()[0]: [b""] * buckets for c in _ASK.split(", ")}
                out["bucket"] = list(range(buckets))
                for at, (a, s, c, h) in enumerate(_runs(hashes[~is_hot], rows[~is_hot], k, size, buckets)):
                    out["keys"][at], out["sizes"][at], out["counts"][at], out["hashes"][at] = (x.tobytes() for x in (a, s, c, h))
                turn = (turn + 1) % buckets
                (a, s, c, h), = _runs(hashes[is_hot], rows[is_hot], k, size, 1)
                for name, x in (("hot_keys", a), ("hot_sizes", s), ("hot_counts", c), ("hot_hashes", h)):
                    out[name][turn] = x.tobytes()
                out["doc_rows"][turn] = np.array([x for key, s in zip(keys, sets, strict=True) for x in (key, len(s))], np.int64).tobytes()
                out["doc_ids"][turn] = np.array([0 if pd.isna(i) else i for i in ids], np.int64).tobytes()
                out["doc_null"][turn] = np.array([pd.isna(i) for i in ids], bool).tobytes()
                used = [at for at in range(buckets) if out["hashes"][at] or out["hot_hashes"][at] or out["doc_rows"][at]]
                yield pd.DataFrame({c: [x[at] for at in used] for c, x in out.items()})

    def count(b: pd.DataFrame) -> pd.DataFrame:
        """One bucket: n-grams of two classes or more go on to their classes;
        documents pass through."""
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(b[name]), kind)

        times = joined("counts", np.uint32)
        keys, sizes = np.repeat(joined("keys", np.int64), times), np.repeat(joined("sizes", np.uint32), times)
        hashes = joined("hashes", np.uint64)
        # ranges of hashes one after the other: sorting copies, of all at once, would be the most of a task's memory
        ranges = -(-8 * len(hashes) // RANGE_BYTES)
        own = (hashes >> np.uint64(40)) % np.uint64(max(1, ranges))
        parts = [_shared(keys[m], sizes[m], hashes[m]) for m in (np.flatnonzero(own == r) for r in range(ranges)) if len(m)]
        keys, sizes, hashes, df = (np.concatenate([x[k] for x in parts] + [np.empty(0, kind)])
                                   for k, kind in enumerate((np.int64, np.uint32, np.uint64, np.uint32)))
        times = joined("hot_counts", np.uint32)
        hot = joined("hot_hashes", np.uint64)
        keys = np.concatenate((keys, np.repeat(joined("hot_keys", np.int64), times)))
        sizes = np.concatenate((sizes, np.repeat(joined("hot_sizes", np.uint32), times)))
        hashes, df = np.concatenate((hashes, hot)), np.concatenate((df, np.full(len(hot), _HOT)))
        out: dict[str, list] = {c: [] for c in ("target", "keys", "sizes", "hashes", "dfs", "id", "key", "n")}
        for target, part in enumerate(_deal(keys.view(np.uint64), buckets)):
            if len(part):
                for name, x in (("target", target), ("keys", keys[part].tobytes()), ("sizes", sizes[part].tobytes()),
                                ("hashes", hashes[part].tobytes()), ("dfs", df[part].tobytes()), ("id", None),
                                ("key", None), ("n", None)):
                    out[name].append(x)
        docs = joined("doc_rows", np.int64).reshape(-1, 2)
        ids, null = joined("doc_ids", np.int64).tolist(), joined("doc_null", bool).tolist()
        for i, is_null, (key, size) in zip(ids, null, docs.tolist(), strict=True):
            for name in ("target", "keys", "sizes", "hashes", "dfs"):
                out[name].append(None)
            out["id"].append(None if is_null else i)
            out["key"].append(key)
            out["n"].append(size)
        return pd.DataFrame(out, dtype=object)

    met = staged(texts.mapInPandas(ask, _ASK).groupBy("bucket").applyInPandas(
        count, "target int, keys binary, sizes binary, hashes binary, dfs binary, id long, key long, n long"), "columns")

    def prefixes(b: pd.DataFrame) -> pd.DataFrame:
        """Classes of one target bucket whose prefix holds a shared n-gram."""
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(b[name]), kind)

        keys, sizes = joined("keys", np.int64), joined("sizes", np.uint32).astype(np.int64)
        hashes, df = joined("hashes", np.uint64), joined("dfs", np.uint32)
        order = np.lexsort((hashes, df, keys))
        keys, sizes, hashes, df = keys[order], sizes[order], hashes[order], df[order]
        new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])))
        keys, sizes, hashes = keys[new], sizes[new], hashes[new]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        out = []
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            size = int(sizes[a])
            prefix = size - -(-size * num // den) + 1
            shared = prefix - (size - (z - a))
            if shared > 0:
                out.append((int(keys[a]), size, hashes[a:a + shared].view(np.int64).tolist(), hashes[a:z].tobytes()))
        return pd.DataFrame(out, columns=["key", "n", "prefix", "own"])

    active = (met.where("target is not null").select("target", "keys", "sizes", "hashes", "dfs")
              .groupBy("target").applyInPandas(prefixes, "key long, n long, prefix array<long>, own binary"))
    return met.where("target is null").select("id", "key", "n"), staged(active, "classes")


def _overlaps(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of left x right link.  Columns come rarest first, in blocks; pairs
    that cannot reach their bound any more are discarded after each block."""
    every = np.unique(np.concatenate((left, right)))
    rows = np.repeat(np.arange(len(every)), [len(sets[i]) for i in every])
    _, column, count = np.unique(np.concatenate([sets[i] for i in every]), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    rows, column = rows[keep], column[keep]
    order = np.argsort(count, kind="stable")
    place = np.empty(len(count), np.int64)
    place[order] = np.arange(len(count)) - int((count == 1).sum())
    column = place[column]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    li, ri = np.searchsorted(every, left), np.searchsorted(every, right)
    # link: (den + num) * overlap >= num * (n + m)
    need = -(-num * (size[left][:, None] + size[right][None, :]) // (den + num))
    overlap = np.zeros(need.shape, np.float32)
    rest = np.bincount(rows, minlength=len(every))
    alive_l, alive_r = np.arange(len(li)), np.arange(len(ri))
    at = 0
    while at < len(rows) and len(alive_l) and len(alive_r):
        stop = np.searchsorted(column, column[at] + _COLUMNS)
        base = column[at]
        r, c = rows[at:stop], column[at:stop] - base
        block = np.zeros((len(every), int(c.max()) + 1), np.float32)
        block[r, c] = 1
        rest = rest - np.bincount(r, minlength=len(every))
        overlap[np.ix_(alive_l, alive_r)] += block[li[alive_l]] @ block[ri[alive_r]].T
        able = (overlap[np.ix_(alive_l, alive_r)] + np.minimum(rest[li[alive_l]][:, None], rest[ri[alive_r]][None, :])
                >= need[np.ix_(alive_l, alive_r)])
        alive_l, alive_r = alive_l[able.any(axis=1)], alive_r[able.any(axis=0)]
        at = stop
    return overlap >= need


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges (root, row) of a spanning forest of the links."""
    todo = set(left.tolist()) | set(right.tolist())
    at_l, at_r = {x: i for i, x in enumerate(left.tolist())}, {x: i for i, x in enumerate(right.tolist())}
    while todo:
        root = todo.pop()
        front = [root]
        while front:
            near = np.zeros(0, np.int64)
            rows = [at_l[x] for x in front if x in at_l]
            cols = [at_r[x] for x in front if x in at_r]
            if rows:
                near = right[link[rows].any(axis=0)]
            if cols:
                near = np.concatenate((near, left[link[:, cols].any(axis=1)]))
            front = [x for x in set(near.tolist()) if x in todo]
            todo.difference_update(front)
            for x in front:
                yield root, x


def _tile(num: int, den: int):
    def product(b: pd.DataFrame) -> pd.DataFrame:
        edges = []
        for _, f in b.groupby("family", sort=False):
            if len(f) < 2:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in f["own"]]
            size, keys = f["n"].to_numpy(np.int64), f["key"].to_numpy(np.int64)
            part, a, z = f["part"].to_numpy(int), int(f["a"].iloc[0]), int(f["b"].iloc[0])
            left, right = np.flatnonzero(part == a), np.flatnonzero(part == z)
            if len(left) and len(right):
                link = _overlaps(sets, size, left, right, num, den)
                edges += [(int(keys[x]), int(keys[y])) for x, y in _forest(link, left, right)]
        return pd.DataFrame(edges, columns=["src", "dst"])

    return product


def _links(active: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between classes that connect exactly what links connect."""
    spark = active.sparkSession
    posts = active.select("key", F.explode("prefix").alias("h"))
    first = posts.groupBy("h").agg(F.min("key").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    stars = posts.join(first, "h").where("key <> first").select(F.col("key").alias("src"), F.col("first").alias("dst"))
    family = components(stars).select(F.col("node").alias("key"), F.col("component").alias("family"))
    rows = staged(active.select("key", "n", "own").join(family, "key"), "rows")
    size = (rows.groupBy("family").agg(F.count("*").alias("c"), F.sum(F.octet_length("own")).alias("bytes"))
            .withColumn("parts", F.ceil(F.greatest(F.col("c") / TILE_ROWS, F.col("bytes") / TILE_BYTES)).cast("int")))
    total = size.agg(F.sum("bytes")).first()[0] or 0
    packs = max(shuffle_partitions(spark), -(-total // TILE_BYTES))
    tiles = (rows.join(size.select("family", "parts"), "family")
             .withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("family", "key", "n", "own", "part", F.least("part", "other").alias("a"),
                     F.greatest("part", "other").alias("b"),
                     F.when(F.col("parts") == 1, F.pmod(F.xxhash64("family"), F.lit(packs))).otherwise(F.col("family")).alias("pack"),
                     (F.col("parts") > 1).alias("alone")))
    return tiles.groupBy("alone", "pack", "a", "b").applyInPandas(_tile(num, den), "src long, dst long")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of
    every row; rows link when den * intersection >= num * union."""
    texts = bounded_batches(df).select(F.col(id_col).cast("long").alias("id"),
                      F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("t"))
    docs, active = _columns(texts, n, num, den)
    linked = components(_links(active, num, den)).select(F.col("node").alias("key"), "component")
    docs = docs.join(linked, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = docs.where("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    return (docs.join(least, "component", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id")))
