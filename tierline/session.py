"""Session construction and the shared scratch location.

On a cluster, ``spark.checkpoint.dir`` names a shared folder (HDFS / object
store).  All lineage cuts and staged writes go below it.  Where it is unset a
temporary folder serves a local master (tests); any other master is an error.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Parquet writes of staged tables: let dynamic overwrite replace only
    # the touched hash buckets of an upsert target.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, app: str = "tierline",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def sized_conf(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing for a job reading ``input_bytes``: file splits and
    post-shuffle partitions of about ``partition_bytes`` (so a task's share
    fits executor memory and spills rarely), and at least two tasks per core.
    AQE then coalesces small shuffle partitions and splits skewed ones.

    Example: 100 TB on 1000 executors x 8 cores -> 409 600 initial shuffle
    partitions of 256 MB, about 51 waves of 8 000 tasks.
    """
    n = max(2 * cores, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        # a machine-local folder serves only where driver and executors are
        # one process (tests, local runs)
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tierline-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", root)
        except Exception:  # noqa: BLE001 - a core setting may be read-only at run time
            pass
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    root = _checkpoint_root(spark)
    path = os.path.join(root, "tierline", f"{name}-{uuid.uuid4().hex[:12]}")
    return path


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint into the shared folder (never localCheckpoint)."""
    spark = spark or df.sparkSession
    _checkpoint_root(spark)
    return df.checkpoint(eager=True)


def staged(df, name: str):
    """``df`` written below the shared folder and read again, column by column
    where a reader needs few."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that tasks hand to Python small: a few long rows
    fill one."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
