"""Prefix scans over the splits of files.

A line, or what stands between two commas, means different things inside and
outside of quotes, and whether it starts inside depends on everything before
it.  Each split is therefore summarised for both starting states (one row a
split); the summaries of the splits of a file are composed in order, and every
split gets its own starting state from them.  A file is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines or pieces that a scan works on at once.
BLOCK = 1 << 16


def _before(part: list[str], order: str):
    return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _compose(df: DataFrame, part: list[str], order: str) -> DataFrame:
    """Add ``_odd`` and ``_fixed``: what the steps before a row do together.
    A step maps outside to ``_o`` and inside to ``_i`` (both say inside).  It
    keeps or swaps the state, or sets it; what counts is the last that sets
    it, and whether the swaps after it are odd."""
    w = _before(part, order)
    swap = (F.col("_o") & ~F.col("_i")).cast("int")
    out = df.withColumn("_swaps", F.coalesce(F.sum(swap).over(w), F.lit(0)))
    fixed = F.when(F.col("_o") == F.col("_i"), F.struct(F.col(order), (F.col("_o") != (F.col("_swaps") % 2 == 1)).alias("v")))
    return (out.withColumn("_fixed", F.max(fixed).over(w)["v"])
            .withColumn("_odd", F.col("_swaps") % 2 == 1).drop("_swaps"))


def _given(start: Column) -> Column:
    """State before a row when its block starts in ``start``."""
    return F.coalesce(F.col("_fixed"), start) != F.col("_odd")


def split_starts(splits: DataFrame) -> DataFrame:
    """_file, _blk, ``_inside`` and ``_before`` of splits given by what they do
    to either state (_o, _i) and how much they hold when they start in it
    (_n_o, _n_i): the state each starts in, and the sum before it in its file."""
    found = _compose(splits, ["_file"], "_blk").withColumn("_inside", _given(F.lit(False)))
    own = F.when(F.col("_inside"), F.col("_n_i")).otherwise(F.col("_n_o"))
    return found.select("_file", "_blk", "_inside", F.coalesce(F.sum(own).over(_before(["_file"], "_blk")), F.lit(0)).alias("_before"))
