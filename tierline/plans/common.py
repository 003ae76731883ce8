"""Shared pieces of the registered plans: table loading and the fixed
parameters that make a run reproducible (tenant, batch, landing time)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENANT = "acme"
BATCH = "batch-0001"
INGESTED_AT = "2024-02-01T00:00:00"
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"   # Spark pattern for timestamp text
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"     # the same text in DuckDB strftime


# Tables that grow with the scale factor; a scan of one of them that yields
# fewer partitions than the cluster has cores (one file, one row group) is
# spread round-robin so per-row JSON / regex work uses every core.  With real
# inputs (many files / row groups) the check is false and nothing moves.
FACT_TABLES = {"lineitem", "orders", "events", "documents", "pages", "conversations"}


def num_partitions(df: DataFrame) -> int | None:
    """Planned input partitions (None where the RDD view is unavailable)."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a remote (Connect) session
        return None


#: Set by the local bench and test sessions, whose files hold one row group.
SPREAD_SMALL_FILES = False


def spread(df: DataFrame) -> DataFrame:
    if not SPREAD_SMALL_FILES:
        return df
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return df
    n = num_partitions(df)
    if n is not None and n < cores:
        return df.repartition(cores)
    return df


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows dealt over the session's tasks, for plans that make much
    work of every row: a table's file may be one row group, which one task
    would read and work on whatever the number of cores."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in FACT_TABLES else df


def ts_text(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, TS_FMT)


def r2(c, n: int = 2):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n)
