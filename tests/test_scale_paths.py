"""Paths that only matter at scale, forced at small size: split files and
bucket-local upserts."""

import glob
import json
import os

from pyspark.sql import functions as F

from tierline.sources import sinks
from tierline.sources.landing import land_csv


def test_csv_row_numbers_over_split_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "csv")
    os.makedirs(d)
    for f in range(2):
        with open(os.path.join(d, f"part{f}.csv"), "w") as fh:
            fh.write("k,v\n")
            for i in range(3000):
                fh.write(f"{f}-{i},value-{i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")     # many splits per file
    try:
        land = land_csv(spark, d, "split", "acme", "b1", "2024-01-01T00:00:00")
        rows = [(json.loads(r.payload)["k"], json.loads(r.metadata)["row_number"]) for r in land.bronze.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 6000
    for k, rn in rows:
        assert int(k.split("-")[1]) == rn


def test_upsert_rewrites_only_touched_buckets(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "silver")
    base = spark.range(0, 2000).select(F.col("id").alias("k"), F.lit(0).alias("v"))
    sinks.upsert_table(spark, path, base, "k", n_buckets=16)
    before = {p: os.path.getmtime(p) for p in glob.glob(path + "/_bucket=*/*.parquet")}
    batch = spark.createDataFrame([(5, 1), (7, 1), (5000, 1)], "k long, v int")
    touched = {r[0] for r in sinks.with_bucket(batch, "k", 16).select(sinks.BUCKET_COL).distinct().collect()}
    sinks.upsert_table(spark, path, batch, "k", n_buckets=16)
    after = {p: os.path.getmtime(p) for p in glob.glob(path + "/_bucket=*/*.parquet")}
    for p, t in before.items():
        b = int(p.split("_bucket=")[1].split("/")[0])
        if b not in touched:
            assert after.get(p) == t, p          # untouched bucket files are left as they were
    out = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert len(out) == 2001 and out[5] == 1 and out[7] == 1 and out[5000] == 1 and out[6] == 0


def test_profile_categorical_boundary(spark):
    """Categorical means 2..25 distinct values (not all unique); the sketch
    pre-filter must not change the exact answer at the boundary."""
    from tierline.operators.charts import profile_columns
    rows = [(i % 25, i % 26, i, i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "c25 long, c26 long, cid long, c2 long") \
        .select(*[F.concat(F.lit("v"), F.col(c).cast("string")).alias(c) for c in ["c25", "c26", "cid", "c2"]])
    got = {r.name: r.categorical for r in profile_columns(df).collect()}
    assert got == {"c25": True, "c26": False, "cid": False, "c2": True}


def test_lookup_join_runs_no_job_while_planning(spark):
    from tierline.operators.joins import lookup_join
    from tierline.session import sized_conf
    fact = spark.range(0, 5000).select((F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    dim = spark.range(0, 50).select(F.col("id").alias("k"), F.raise_error(F.lit("computed")).cast("string").alias("name"))
    joined = lookup_join(fact, dim, "k")            # would fail here if the side were counted
    assert joined.columns == ["k", "v", "name"]
    conf = sized_conf(100 * (1 << 40), 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) == 409600


def test_upsert_keeps_its_bucket_count(spark, tmpdir_path):
    import pytest
    path = os.path.join(tmpdir_path, "silver")
    rows = lambda v: spark.range(0, 100).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    sinks.upsert_table(spark, path, rows(1), "k", n_buckets=8)
    sinks.upsert_table(spark, path, rows(2), "k")
    with pytest.raises(ValueError):
        sinks.upsert_table(spark, path, rows(3), "k", n_buckets=4)
    doubled = rows(4).unionByName(rows(5)).unionByName(spark.createDataFrame([(None, 9)], "k long, v int"))
    sinks.upsert_table(spark, path, doubled, "k", order_by=["v"])
    got = spark.read.parquet(path)
    assert got.count() == 100 and {r.v for r in got.collect()} == {5}
    rows(0).write.parquet(os.path.join(tmpdir_path, "other"))
    with pytest.raises(ValueError):
        sinks.upsert_table(spark, os.path.join(tmpdir_path, "other"), rows(1), "k")


def test_replaced_table_always_has_a_version(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "gold")
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    assert sinks.create_if_missing(spark, path, "v int") and not sinks.create_if_missing(spark, path, "v int")
    for v in range(4):
        sinks.replace_table(spark, one(v), path)
    assert len(sinks.remove_old_versions(spark, path, keep=2)) == 3
    assert [r.v for r in sinks.read_table(spark, path).collect()] == [3]
    assert len(glob.glob(path + "/v*")) == 2


def test_conflict_update_takes_one_row_a_key(spark):
    from tierline.operators import merge
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, o string")
    batch = spark.createDataFrame([(1, "new", 1), (1, "newer", 2), (None, "lost", 3), (3, "c", 1)], "k long, v string, at int")
    got = merge.conflict_update(target, batch, "k", ["v"], order_by=["at"])
    assert sorted(map(tuple, got.collect())) == [(1, "newer", "x"), (2, "b", "y"), (3, "c", None)]


def test_flatten_keeps_the_record_that_landed_last(spark):
    from tierline.operators.flatten import flatten
    from tierline.sources.landing import envelope
    df = spark.range(0, 24).select((F.col("id") % 6).cast("string").alias("k"), F.col("id").alias("v"), F.col("id").alias("_pos"))
    bronze = envelope(df, "s", "t", "b", "2024-01-01T00:00:00", position="_pos")
    got = {r.k: r.v for r in flatten(bronze, [("k", "string"), ("v", "int")], "k").collect()}
    assert got == {str(k): k + 18 for k in range(6)}
