"""Bounded results, paging and ordering (L1-L9), plus top-k per group.

Limits here are the feature itself (a bounded answer, a page, a top-k).  Sorts
that end in a limit become ``TakeOrderedAndProject`` (per-partition top-n, then
a merge of n rows per partition), so no global sort of the input happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.functions.jsonx import TO_JSON_OPTS
from tierline.session import cut_lineage

MAX_QUERY_ROWS = 500      # fixed: ad-hoc result cap
AGENT_MAX_ROWS = 1000     # fixed: capped query maximum
AGENT_DEFAULT_ROWS = 20
RESULT_CHAR_BUDGET = 4000  # fixed: size budget of a capped result
PREVIEW_DEFAULT, PREVIEW_MAX = 20, 100
PAGE_MAX = 200


def _order(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def bounded(df: DataFrame, order_by: list, cap: int = MAX_QUERY_ROWS) -> DataFrame:
    """L1 at most ``cap`` rows plus a ``truncated`` flag from a ``cap+1``-th row
    (one extra row fetched, never a full count)."""
    top = df.orderBy(*_order(order_by)).limit(cap + 1)
    w = Window.orderBy(*_order(order_by))   # over at most cap+1 rows
    ranked = top.withColumn("_rn", F.row_number().over(w))
    flag = F.max("_rn").over(Window.partitionBy(F.lit(1))) > cap
    return ranked.withColumn("truncated", flag).filter(F.col("_rn") <= cap).drop("_rn")


def _asked(n: int | None, default: int, most: int | None) -> int:
    """The number of rows to return: never fewer than asked for."""
    n = default if n is None else int(n)
    if n < 1 or (most is not None and n > most):
        raise ValueError(f"rows must be from 1 to {most}, not {n}" if most else f"rows must be positive, not {n}")
    return n


def capped(df: DataFrame, order_by: list, n: int | None = None, most: int | None = AGENT_MAX_ROWS) -> DataFrame:
    """L2 caller limit, default 20.  More than ``most`` is an error, not fewer
    rows; ``most=None`` sets no maximum."""
    return df.orderBy(*_order(order_by)).limit(_asked(n, AGENT_DEFAULT_ROWS, most))


def preview(df: DataFrame, order_by: list, n: int | None = None, most: int | None = PREVIEW_MAX) -> DataFrame:
    """L3 preview, default 20; more than ``most`` is an error."""
    return df.orderBy(*_order(order_by)).limit(_asked(n, PREVIEW_DEFAULT, most))


def size_budget(df: DataFrame, order_by: list, budget: int = RESULT_CHAR_BUDGET) -> DataFrame:
    """L4 keep leading rows while the compact JSON of the rows (each plus two
    separator characters) stays within ``budget``.  A row takes at least four
    characters, so the first ``budget / 4`` rows hold every row that fits and
    the running window sees no more."""
    top = df.orderBy(*_order(order_by)).limit(budget // 4 + 1)
    w = Window.orderBy(*_order(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns]), TO_JSON_OPTS)) + 2
    return top.withColumn("_run", F.sum(size).over(w)).filter(F.col("_run") <= budget).drop("_run")


#: Pages that end beyond this many rows are found by ranges.
SHALLOW_ROWS = 10_000


def page(df: DataFrame, order_by: list, page_no: int, page_size: int, most: int | None = PAGE_MAX) -> DataFrame:
    """L5 offset paging: page >= 1; a size above ``most`` is an error.  A page
    near the start is a top-n; a deep one would make that hold all rows before
    it and goes to ``deep_page``."""
    page_size = _asked(page_size, PAGE_MAX, most)
    offset = (_asked(page_no, 1, None) - 1) * page_size
    if offset + page_size > SHALLOW_ROWS:
        return deep_page(df, order_by, offset, page_size)
    return df.orderBy(*_order(order_by)).offset(offset).limit(page_size)


def _by_range(df: DataFrame, order_by: list, part: str) -> DataFrame:
    """``df`` dealt into ranges of the order (boundaries sampled), written to
    the shared folder, with the number of each row's range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *_order(order_by)).sortWithinPartitions(*_order(order_by)).withColumn(part, F.spark_partition_id())


def deep_page(df: DataFrame, order_by: list, offset: int, size: int) -> DataFrame:
    """The rows from ``offset`` on of ``df`` in order.  Rows are dealt into
    ranges, the ranges counted (one number a range comes to the driver), and
    only those that hold the page are read again and sorted: no task sees more
    rows than a few ranges have, however deep the page is."""
    rows = cut_lineage(_by_range(df, order_by, "_range"))
    counts = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    chosen, skip, at = [], 0, 0
    for part, n in counts:
        if at + n > offset and at < offset + size:
            skip = offset - at if not chosen else skip
            chosen.append(part)
        at += n
    held = rows.filter(F.col("_range").isin(chosen)) if chosen else rows.limit(0)
    return held.orderBy(*_order(order_by)).offset(max(0, skip)).limit(size).drop("_range")


def number_rows(df: DataFrame, order_by: list, out: str) -> DataFrame:
    """``df`` with each row's place (from 0) in a total order, without one task
    that sees all rows: places in ranges, and the ranges' sizes before."""
    rows = cut_lineage(_by_range(df, order_by, "_range").withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)          # one row a range
    starts = sizes.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(starts, "_range").withColumn(out, F.col("_at") - F.col("_first") + F.col("_before")).drop("_range", "_at", "_first", "_before")


def top_k(df: DataFrame, order_by: list, k: int) -> DataFrame:
    """L6 / L7 / L8 top-k by a multi-key order."""
    return df.orderBy(*_order(order_by)).limit(k)


def top_k_per_group(df: DataFrame, group_cols: list[str], order_by: list, k: int,
                    salt_buckets: int = 64, salt_col: str | None = None) -> DataFrame:
    """Top-k rows per group without putting a hot group in one task.

    Phase 1 ranks inside (group, salt) slices, salt = hash of ``salt_col`` (or
    of the whole row) into ``salt_buckets``; phase 2 ranks at most
    ``salt_buckets * k`` survivors per group.  Exact: a group's top-k is among
    the union of its slices' top-k.
    """
    salt_src = F.col(salt_col) if salt_col else F.struct(*[F.col(c) for c in df.columns])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_src), F.lit(salt_buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*_order(order_by))
    pre = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*_order(order_by))
    return pre.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k) \
        .drop("_salt", "_r1")


def rows_as_json(df: DataFrame, alias: str = "row_json") -> DataFrame:
    """L9 one compact JSON object per row."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), TO_JSON_OPTS).alias(alias))
