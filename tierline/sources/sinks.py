"""Layer tables on Parquet (S13-S16, W1, W2, W8, W9) and the bucketed
upsert table (W3 on storage, H2).

Paths: ``{root}/{tenant}/{layer}/{name}``.  Bronze and audit tables are
append-only and partitioned by date (partition pruning on reads).  Silver and
gold tables are replaced by writing a new version directory and then adding a
line that names it to ``_versions``; the latest name is the table.  Nothing is
overwritten, so a reader sees the old table or the new one, never none, and a
failed write leaves the old one.  ``remove_old_versions`` clears what nobody
reads any more.  Upsert targets are hash-bucketed by key; the number of buckets
is stored with the table, and only the buckets a batch touches are read and
rewritten (dynamic partition overwrite).
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions.jsonx import TO_JSON_OPTS
from tierline.operators import merge
from tierline.session import cut_lineage

BUCKET_COL = "_bucket"


def layer_path(root: str, tenant: str, layer: str, name: str) -> str:
    return os.path.join(root, tenant, layer, name)


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path object of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there.  A failing read is an error, not a no."""
    fs, at = _folder(spark, path)
    return fs.exists(at)


def append_bronze(df: DataFrame, path: str) -> None:
    """S14 append the batch only (not the whole table), partitioned by the
    landing date taken from ``ingested_at``."""
    (df.withColumn("ingest_date", F.substring("ingested_at", 1, 10))
     .write.mode("append").partitionBy("ingest_date").parquet(path))


def read_bronze(spark: SparkSession, path: str, dates: list[str] | None = None) -> DataFrame:
    """S13 bronze scan; a date list prunes partitions."""
    # partition values stay text (no type inference of the date folders)
    df = spark.read.parquet(path)
    df = df.withColumn("ingest_date", F.col("ingest_date").cast("string"))
    return df.filter(F.col("ingest_date").isin(dates)) if dates else df


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> str:
    """S15 / W1 create-or-replace: write a new version, then name it.  Names
    sort by time."""
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(os.path.join(path, version))
    spark.createDataFrame([(version,)], "value string").coalesce(1) \
        .write.mode("append").text(os.path.join(path, "_versions"))
    return version


def _latest(spark: SparkSession, path: str) -> str:
    return spark.read.text(os.path.join(path, "_versions")).agg(F.max("value")).first()[0]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S13 read the current version of a replaced table."""
    return spark.read.parquet(os.path.join(path, _latest(spark, path)))


def remove_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all versions before the latest ``keep`` ones, and folders of
    writes that failed before them.  ``keep`` covers readers still at work."""
    fs, at = _folder(spark, path)
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName().startswith("v"))
    done = sorted(r["value"] for r in spark.read.text(os.path.join(path, "_versions")).collect())   # a line a replacement
    gone = [n for n in names if n < done[-keep:][0]]
    for n in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, n), True)
    return gone


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a replaced table has a version."""
    return _exists(spark, os.path.join(path, "_versions"))


def create_if_missing(spark: SparkSession, path: str, schema) -> bool:
    """W2 create an empty table with a declared schema when none exists."""
    if table_exists(spark, path):
        return False
    replace_table(spark, spark.createDataFrame([], schema), path)
    return True


def append_with_new_columns(spark: SparkSession, df: DataFrame, path: str) -> None:
    """W8 appends whose new columns are added to the table (missing ones are
    null in old rows): read with schema merging."""
    df.write.mode("append").parquet(path)


def append_run(df: DataFrame, path: str) -> None:
    """S16 run trail: nested values to JSON text, one append per run batch."""
    cols = []
    for f in df.schema.fields:
        simple = f.dataType.typeName() in ("string", "long", "integer", "double", "boolean", "timestamp",
                                           "timestamp_ntz", "date", "short", "float", "byte")
        cols.append(F.col(f.name) if simple else F.to_json(F.col(f.name), TO_JSON_OPTS).alias(f.name))
    df.select(*cols).write.mode("append").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    """W9 append audit events partitioned by day."""
    df.withColumn("day", F.to_date("created_at").cast("string")).write.mode("append") \
        .partitionBy("day").parquet(path)


def with_bucket(df: DataFrame, key, n_buckets: int) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(BUCKET_COL, F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(n_buckets)).cast("int"))


#: Buckets of a new upsert table where the caller names none.  Choose so that a
#: bucket stays a few hundred MB: it is the unit that an upsert rewrites.
DEFAULT_BUCKETS = 64


def _stored_buckets(spark: SparkSession, path: str, asked: int | None) -> int | None:
    """The table's bucket count; None where there is no table yet."""
    meta = os.path.join(path, "_buckets")
    if _exists(spark, meta):
        stored = int(spark.read.text(meta).first()["value"])
        if asked not in (None, stored):
            raise ValueError(f"{path} has {stored} buckets, not {asked}")
        return stored
    if _exists(spark, path):
        raise ValueError(f"{path} is there, but is no upsert table")
    return None


def upsert_table_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, os.path.join(path, "_buckets"))


#: In a change set: +1 for a row as it is now, -1 for a row as it was.
SIGN_COL = "_sign"


def upsert_table(spark: SparkSession, path: str, batch: DataFrame, key, n_buckets: int | None = None,
                 order_by: list | None = None, deleted: str | None = None, log: str | None = None) -> None:
    """W3 keyed upsert into a hash-bucketed Parquet table.

    The batch is deduplicated by key (latest by ``order_by``, else by the whole
    row) and written out once.  Only buckets it touches are read (partition
    filter) and rewritten with dynamic partition overwrite, one file each;
    other buckets are neither read nor written.  A key's bucket depends on the
    table's bucket count, which is stored at the first write and checked.

    ``deleted`` names a boolean column of the batch (not of the table): rows
    where it is true remove their key.  ``log`` is a folder for the change set
    of this call: for every key of the batch the row as it was and the row as
    it is now (``read_changes``).  It is written before the table changes and
    never again, so a call that failed half way can be repeated with the same
    folder.  A table has one writer at a time.
    """
    keys = [key] if isinstance(key, str) else list(key)
    stored = _stored_buckets(spark, path, n_buckets)
    buckets = stored or n_buckets or DEFAULT_BUCKETS
    rows = batch.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    rows = merge.keep_latest(rows, keys, order_by or [c for c in batch.columns if c not in keys] or keys)
    b = cut_lineage(with_bucket(rows, keys, buckets), spark)
    live = b.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else b
    if stored is None:
        if log:
            _log_changes(spark, live.withColumn(SIGN_COL, F.lit(1)), log)
        spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.text(os.path.join(path, "_buckets"))
        live.repartition(buckets, BUCKET_COL).write.mode("append").partitionBy(BUCKET_COL).parquet(path)
        return
    touched = [r[0] for r in b.select(BUCKET_COL).distinct().collect()]   # <= the bucket count
    target = spark.read.schema(live.schema).parquet(path).filter(F.col(BUCKET_COL).isin(touched))
    if log:
        was = target.join(b.select(*keys), keys, "left_semi").withColumn(SIGN_COL, F.lit(-1))
        _log_changes(spark, was.unionByName(live.withColumn(SIGN_COL, F.lit(1))), log)
    if not touched:
        return
    kept = target.join(b.select(*keys), keys, "left_anti")
    out = kept.unionByName(live.select(*target.columns))
    before = _bucket_files(spark, path, touched) if deleted else {}
    # staged in this job's output, swapped per bucket at commit
    (out.repartition(len(touched), BUCKET_COL).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET_COL).parquet(path))
    # a bucket that lost its last row is not in the output: its old files are still there
    for bucket, names in _bucket_files(spark, path, before).items():
        if names and names == before[bucket]:
            fs, at = _folder(spark, os.path.join(path, f"{BUCKET_COL}={bucket}"))
            fs.delete(at, True)


def _bucket_files(spark: SparkSession, path: str, buckets) -> dict[int, set[str]]:
    out = {}
    for bucket in buckets:
        fs, at = _folder(spark, os.path.join(path, f"{BUCKET_COL}={bucket}"))
        out[bucket] = {f.getPath().getName() for f in fs.listStatus(at)} if fs.exists(at) else set()
    return out


def _log_changes(spark: SparkSession, changes: DataFrame, log: str) -> None:
    if not _exists(spark, os.path.join(log, "_SUCCESS")):
        changes.drop(BUCKET_COL).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(log)


def read_changes(spark: SparkSession, log: str) -> DataFrame:
    """The change set of an ``upsert_table`` call."""
    return spark.read.parquet(log)


def read_table_or_none(spark: SparkSession, path: str, keys: DataFrame, key: str) -> DataFrame | None:
    """The rows of an upsert table with the given keys, read from the buckets
    that can hold them; None where there is no table."""
    buckets = _stored_buckets(spark, path, None)
    if buckets is None:
        return None
    touched = [r[0] for r in with_bucket(keys, key, buckets).select(BUCKET_COL).distinct().collect()]   # <= the bucket count
    rows = spark.read.parquet(path).filter(F.col(BUCKET_COL).isin(touched)) if touched else spark.read.parquet(path).limit(0)
    return rows.join(keys, key, "left_semi")
