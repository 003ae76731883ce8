"""Row position within a source file, computed without funnelling rows
through one task (H7: first-seen order must come from a stable position).

A split file is read as several blocks, possibly packed into different
partitions.  Rows of one block are contiguous inside its partition, so the
position of a row in its file = (rows in earlier blocks of that file) +
(position inside its block).  Only a per-block count frame (one row per block)
is aggregated and joined back; the rows themselves never move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROW_MASK = (1 << 33) - 1


def file_row_number(df: DataFrame, out_col: str = "_row_number") -> DataFrame:
    """Add ``_file`` (path) and ``out_col`` (0-based row index within the
    file) to a frame read straight from files (or to one that carries the
    metadata as ``_file`` and ``_blk``, as a micro-batch does)."""
    carried = {"_file", "_blk"} <= set(df.columns)
    place = [] if carried else [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_blk")]
    base = df.select("*", *place, F.monotonically_increasing_id().alias("_mid"))
    df = df.drop("_file", "_blk")
    base = base.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_row", F.col("_mid").bitwiseAND(F.lit(_ROW_MASK)))
    blocks = (base.groupBy("_file", "_blk", "_pid")
              .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_cnt")))
    w = Window.partitionBy("_file").orderBy("_blk", "_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("_file").alias("_kf"), F.col("_blk").alias("_kb"),
                           F.col("_pid").alias("_kp"), "_first",
                           F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_before"))
    out = base.join(blocks, (F.col("_file") == F.col("_kf")) & (F.col("_blk") == F.col("_kb"))
                    & (F.col("_pid") == F.col("_kp")), "inner")
    pos = F.col("_before") + (F.col("_row") - F.col("_first"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "_file", pos.cast("long").alias(out_col))
