"""Keyed writes (W3-W8) and keep-one dedup.

Dedup is a hash aggregate with ``max_by`` / ``min_by`` over a struct of the
row: partial aggregation collapses every key to one row per map task before
the shuffle, so a key holding a third of the batch costs no more than any other
(no window over a hot partition).  Upserts then join on keys that are unique on
both sides, so the join cannot skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _order_struct(order_by: list) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    return F.struct(*cols)


def keep_one(df: DataFrame, key, order_by: list, latest: bool) -> DataFrame:
    """One row per key: the greatest (``latest``) or least row by ``order_by``.

    ``order_by`` must end in a unique column to make the winner deterministic.
    """
    keys = _keys(key)
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    pick = F.max_by if latest else F.min_by
    out = df.groupBy(*keys).agg(pick(row, _order_struct(order_by)).alias("_r"))
    return out.select(*keys, *[F.col("_r")[c].alias(c) for c in others]).select(*df.columns)


def keep_earliest(df: DataFrame, key, order_by: list) -> DataFrame:
    """N1 ``ROW_NUMBER() OVER (PARTITION BY key ORDER BY ...) = 1``."""
    return keep_one(df, key, order_by, latest=False)


def keep_latest(df: DataFrame, key, order_by: list) -> DataFrame:
    return keep_one(df, key, order_by, latest=True)


def upsert(target: DataFrame, batch: DataFrame, key, order_by: list | None = None) -> DataFrame:
    """W3 ``INSERT OR REPLACE``: batch rows replace target rows with the same
    key; within the batch the latest row by ``order_by`` wins (H3).
    """
    keys = _keys(key)
    batch = batch.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if order_by:
        batch = keep_latest(batch, keys, order_by)
    kept = target.join(batch.select(*keys), keys, "left_anti")
    return kept.unionByName(batch.select(*target.columns))


def insert_ignore(target: DataFrame, batch: DataFrame, key, order_by: list | None = None) -> DataFrame:
    """W4 ``INSERT OR IGNORE``: only keys absent from the target are added;
    within the batch the earliest row wins (N1)."""
    keys = _keys(key)
    batch = batch.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if order_by:
        batch = keep_earliest(batch, keys, order_by)
    new = batch.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def conflict_update(target: DataFrame, batch: DataFrame, key, update_cols: list[str],
                    order_by: list | None = None) -> DataFrame:
    """W5 ``ON CONFLICT (key) DO UPDATE SET c = excluded.c`` for the chosen
    columns; other columns keep the stored value; new keys are inserted.
    Batch rows without a key are dropped; of several rows with one key the
    latest by ``order_by`` counts (without it, by the updated values)."""
    keys = _keys(key)
    t = target
    batch = batch.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    batch = keep_latest(batch, keys, order_by or update_cols)
    b = batch.select(*keys, *update_cols).withColumn("_in_b", F.lit(True))
    for c in update_cols:
        b = b.withColumnRenamed(c, f"_new_{c}")
    j = t.join(b, keys, "full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("_in_b"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def rewrite(df: DataFrame, predicate, updates: dict) -> DataFrame:
    """W6 ``UPDATE t SET c = e WHERE p`` as a projection."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    out = df
    for c, e in updates.items():
        e = F.expr(e) if isinstance(e, str) else e
        out = out.withColumn(c, F.when(p, e).otherwise(F.col(c)))
    return out


def delete_where(df: DataFrame, predicate) -> DataFrame:
    """W7 ``DELETE FROM t WHERE p`` -> keep rows where p is not true."""
    p = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~F.coalesce(p, F.lit(False)))


def add_column_if_missing(df: DataFrame, name: str, default, dtype: str) -> DataFrame:
    """W8 ``ADD COLUMN IF NOT EXISTS name dtype DEFAULT v``."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(default).cast(dtype))


def missing_rows(src: DataFrame, dst: DataFrame, key) -> DataFrame:
    """J4 ``INSERT INTO dst SELECT * FROM src WHERE id NOT IN (SELECT id FROM dst)``
    (ids are never null, so NOT IN equals a left anti join)."""
    return src.join(dst.select(*_keys(key)), _keys(key), "left_anti")
