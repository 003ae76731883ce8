"""Exact top-k inner products by sorted lists without random access.

Candidates are packed into blocks, queries too, and every query block meets
every candidate block once.  Inside a block each dimension is a list of
candidates sorted by value, read from its better end for the query's sign.
Reading goes on in growing depths; at each depth a candidate's score lies
between a lower bound (unread dimensions at the list's worst value) and an
upper bound (unread dimensions at the last value read).  A query stops when
few candidates have an upper bound that reaches the k-th lower bound: nobody
else can qualify, and the final scores of those left are resolved.  Each block
gives at most k rows a query; a window over these gives the result.

Defined results: rows whose id or vector is null, or whose vector is empty or
holds a null or non-finite component, take no part.  Only vectors of equal
length are compared.  Ties go to the smaller id.  A query does not meet rows
with its own id; repeated candidate rows each take a place, repeated query
rows (same id and vector) are one query, and each vector of an id is a query.
Arithmetic is exact: sums that doubles cannot hold exactly use 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 16384, 1024
#: Parts of the lists read before each test of the bounds.
DEPTHS = (1 / 16, 1 / 4)
#: A query stops when at most this many candidates a wanted row are left.
LEFT = 8
_STEP = 256


def _block_topk(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int):
    """(query row, candidate row, score) of the best k of one block."""
    n, d = x.shape
    reach = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * d
    kind = np.float32 if reach < 2 ** 23 else np.float64 if reach < 2 ** 52 else np.int64
    xs, qs = x.astype(kind), q.astype(kind)
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(xs, order, axis=0)            # ascending
    open_q = np.arange(len(q))
    for part in (*DEPTHS, 1.0):
        if not len(open_q):
            return
        depth = max(1, math.ceil(n * part))
        whole = depth >= n
        high, low = rank >= n - depth, rank < depth          # read from the top / the bottom
        up_hi = np.where(high, xs, lists[n - depth])
        up_lo = np.where(low, xs, lists[depth - 1])
        lo_hi = np.where(high, xs, lists[0])
        lo_lo = np.where(low, xs, lists[-1])
        still = []
        for at in range(0, len(open_q), _STEP):
            rows = open_q[at:at + _STEP]
            part_q = qs[rows]
            if whole:
                upper = lower = part_q @ xs.T
            else:
                plus, minus = np.maximum(part_q, 0), np.minimum(part_q, 0)
                upper = plus @ up_hi.T + minus @ up_lo.T
                lower = plus @ lo_hi.T + minus @ lo_lo.T
            for r, row in enumerate(rows):
                own = np.flatnonzero(ids == qids[row])
                bound = lower[r]
                if len(own):
                    bound = bound.copy()
                    bound[own] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
                kth = np.partition(bound, n - k)[n - k] if n > k else bound.min()
                left = np.flatnonzero(upper[r] >= kth)
                if len(own):
                    left = left[ids[left] != qids[row]]
                if not whole and len(left) > LEFT * k:
                    still.append(row)
                    continue
                score = x[left] @ q[row]
                best = np.lexsort((ids[left], -score))[:k]
                yield row, left[best], score[best]
        open_q = np.array(still, int)


def _pack(batches: pd.DataFrame) -> pd.DataFrame:
    """One row of a block's ids and vectors."""
    b = batches.sort_values("id", kind="stable")
    return pd.DataFrame({"dim": [b["dim"].iloc[0]], "block": [b["block"].iloc[0]],
                         "ids": [b["id"].to_numpy(np.int64).tobytes()],
                         "marks": [b["mark"].to_numpy(np.int64).tobytes()],
                         "vecs": [np.stack(b["v"].to_numpy()).astype(np.int64).tobytes()]})


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows dealt into blocks of about ``size`` rows, packed; their number."""
    n = max(1, math.ceil(rows.count() / size))
    packed = (rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
              .groupBy("dim", "block").applyInPandas(_pack, "dim int, block int, ids binary, marks binary, vecs binary"))
    return packed, n


def topk(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
         scale: int = 256) -> DataFrame:
    """For each row where ``is_query`` holds: its ``k`` best other rows by
    inner product of floor(scale * component): query_id, rank, vec_id, score."""
    v = F.col(vec_col)
    fits = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (df.where(F.coalesce(fits, F.lit(False)) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
            .withColumns({"dim": F.size("v"), "mark": F.xxhash64("v")}))
    candidates, n = _blocks(rows.drop("is_query"), CANDIDATES)
    queries, _ = _blocks(rows.where("is_query").drop("is_query").distinct(), QUERIES)
    queries = (queries.select("dim", F.col("ids").alias("qids"), F.col("marks").alias("qmarks"), F.col("vecs").alias("qvecs"),
                              F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, qids, marks = (np.frombuffer(y, np.int64) for y in (r.ids, r.qids, r.qmarks))
                x, q = (np.frombuffer(y, np.int64).reshape(-1, r.dim) for y in (r.vecs, r.qvecs))
                found = list(_block_topk(x, ids, q, qids, k))
                if found:
                    yield pd.DataFrame({
                        "query_id": np.concatenate([np.full(len(c), qids[row]) for row, c, _ in found]),
                        "mark": np.concatenate([np.full(len(c), marks[row]) for row, c, _ in found]),
                        "vec_id": np.concatenate([ids[c] for _, c, _ in found]),
                        "score": np.concatenate([s for _, _, s in found])})

    pairs = queries.join(candidates.drop("marks"), ["dim", "block"])
    best = pairs.mapInPandas(search, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
