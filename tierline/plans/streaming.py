"""Streaming plans (T1-T4): each runs an ``availableNow`` stream over the
driver's ``events`` file into a fresh folder below the shared checkpoint
root, waits for it, and returns the sink read back as a DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tierline.operators import gold as gold_tables
from tierline.plans.common import ts_text
from tierline.plans.lineage import SQL_DEBOUNCE
from tierline.session import scratch_dir
from tierline.streaming import streams as S

EVENT_FIELDS = [("event_id", "int"), ("ts", "timestamp"), ("user_id", "int"), ("event_type", "string"),
                ("value", "float")]


def _events_src(spark, sf_dir):
    path = os.path.join(sf_dir, "events.parquet")
    return path, spark.read.parquet(path).schema


def _land(spark, sf_dir):
    src, schema = _events_src(spark, sf_dir)
    d = scratch_dir(spark, "stream-landing")
    q = S.land_stream(spark, src, schema, d + "/bronze", d + "/ckpt", "events", "t0", "event_id",
                      ingested_at="2024-02-01T00:00:00")
    q.awaitTermination()
    return d + "/bronze"


def q_stream_landing(spark, sf_dir):
    bronze = spark.read.parquet(_land(spark, sf_dir))
    v = bronze.select(F.try_parse_json("payload").alias("v"), "ingest_date")
    return v.select(F.try_variant_get("v", "$.event_id", "bigint").alias("event_id"),
                    F.try_variant_get("v", "$.user_id", "bigint").alias("user_id"),
                    F.try_variant_get("v", "$.event_type", "string").alias("event_type"),
                    ts_text(F.try_variant_get("v", "$.ts", "timestamp_ntz")).alias("ts"),
                    F.col("ingest_date").cast("string").alias("ingest_date"))


SQL_STREAM_LANDING = """
SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, '2024-02-01' AS ingest_date
FROM events
"""


def q_stream_two_sources(spark, sf_dir):
    """T1 one sink for two streams of different forms: events as typed files,
    and events as JSON lines, whose stream is run again after its only batch
    lost its commit."""
    src, schema = _events_src(spark, sf_dir)
    d = scratch_dir(spark, "stream-shared")
    land = dict(tenant_id="t0", ingested_at="2024-02-01T00:00:00")
    S.land_stream(spark, src, schema, d + "/bronze", d + "/ck1", "typed", position="event_id", **land).awaitTermination()
    table_rows = spark.read.parquet(src).select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))
    table_rows.write.text(d + "/lines")
    for _ in range(2):
        S.land_stream(spark, d + "/lines", None, d + "/bronze", d + "/ck2", "lines", position=None, fmt="text", **land).awaitTermination()
        commits = spark._jvm.org.apache.hadoop.fs.Path(d + "/ck2/commits")
        commits.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, True)
    v = spark.read.parquet(d + "/bronze").select("source", F.try_parse_json("payload").alias("v"))
    return v.select("source", F.try_variant_get("v", "$.event_id", "bigint").alias("event_id"),
                    F.try_variant_get("v", "$.user_id", "bigint").alias("user_id"),
                    F.try_variant_get("v", "$.event_type", "string").alias("event_type"))


SQL_STREAM_TWO_SOURCES = """
SELECT 'typed' AS source, event_id, user_id, event_type FROM events
UNION ALL SELECT 'lines', event_id, user_id, event_type FROM events
"""


def q_stream_refresh(spark, sf_dir):
    bronze_path = _land(spark, sf_dir)
    schema = spark.read.parquet(bronze_path).schema
    d = scratch_dir(spark, "stream-refresh")
    q = S.refresh_stream(spark, bronze_path, schema, EVENT_FIELDS, "user_id", d + "/silver", d + "/ckpt",
                         n_buckets=8, order_by=["ts", "event_id"])
    q.awaitTermination()
    s = spark.read.parquet(d + "/silver")
    return s.select("user_id", "event_id", ts_text("ts").alias("ts"), "event_type")


SQL_STREAM_REFRESH = """
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
"""


def q_stream_debounce(spark, sf_dir):
    src, schema = _events_src(spark, sf_dir)
    d = scratch_dir(spark, "stream-debounce")
    q = S.debounce_stream(spark, src, schema, "user_id", "ts", "event_id", d + "/out", d + "/ckpt")
    q.awaitTermination()
    o = spark.read.parquet(d + "/out").filter("NOT late")
    return o.select(F.col("key").alias("user_id"), "event_id",
                    ts_text(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
                            + F.make_dt_interval(secs=F.col("fired_us") / F.lit(1_000_000))).alias("ts"))


def q_stream_daily(spark, sf_dir):
    src, schema = _events_src(spark, sf_dir)
    d = scratch_dir(spark, "stream-daily")
    q = S.daily_counts_stream(spark, src, schema, "ts", "event_type", d + "/out", d + "/ckpt")
    q.awaitTermination()
    return spark.read.parquet(d + "/out").select("day", "event_type", "n")


SQL_STREAM_DAILY = """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, COUNT(*) AS n FROM events GROUP BY ALL
"""

def q_stream_gold(spark, sf_dir):
    """T2 gold by deltas: events land in three runs (all; those of every third
    user again with another type and value; those of every fifth user as
    removals), each refreshes silver by event and gold by type."""
    src, _ = _events_src(spark, sf_dir)
    d = scratch_dir(spark, "stream-gold")
    u = F.col("user_id")
    e = spark.read.parquet(src).select("event_id", "user_id", "event_type", "value", F.lit(False).alias("gone"))
    runs = [e, e.filter(u % 3 == 0).withColumns({"event_type": F.concat("event_type", F.lit("-late")), "value": F.col("value") + 1}),
            e.filter(u % 5 == 0).withColumn("gone", F.lit(True))]
    fields = [("event_id", "int"), ("user_id", "int"), ("event_type", "string"), ("value", "float"), ("gone", "boolean")]
    table_of = S.Gold(d + "/gold", ["event_type"], ["value"], 8)
    for rows in runs:
        rows.select(F.to_json(F.struct("*")).alias("payload")).write.mode("append").parquet(d + "/bronze")
        S.refresh_stream(spark, d + "/bronze", spark.read.parquet(d + "/bronze").schema, fields, "event_id", d + "/silver", d + "/ckpt",
                         n_buckets=8, gold=[table_of], deleted="gone").awaitTermination()
    out = gold_tables.read(spark, d + "/gold", ["event_type"], ["value"])
    return out.select("event_type", "n_rows", F.round(F.col("value_sum").cast("double"), 2).alias("value_sum"))


SQL_STREAM_GOLD = """
SELECT CASE WHEN user_id % 3 = 0 THEN event_type || '-late' ELSE event_type END AS event_type, COUNT(*) AS n_rows,
       ROUND(SUM(CAST(CASE WHEN user_id % 3 = 0 THEN value + 1 ELSE value END AS DECIMAL(38, 6)))::DOUBLE, 2) AS value_sum
FROM events WHERE user_id % 5 <> 0 GROUP BY ALL
"""


def q_stream_cascade(spark, sf_dir):
    """T2 with a cascade: every micro-batch refreshes silver (latest event per
    user) and then rebuilds a gold table (users per latest event type) from
    silver with a versioned replace (W1)."""
    from tierline.sources.sinks import read_table, replace_table
    bronze_path = _land(spark, sf_dir)
    schema = spark.read.parquet(bronze_path).schema
    d = scratch_dir(spark, "stream-cascade")
    gold = d + "/gold"

    def rebuild_gold(sp, silver_path):
        silver = sp.read.parquet(silver_path)
        replace_table(sp, silver.groupBy("event_type").agg(F.count(F.lit(1)).alias("users")), gold)

    q = S.refresh_stream(spark, bronze_path, schema, EVENT_FIELDS, "user_id", d + "/silver", d + "/ckpt",
                         n_buckets=8, order_by=["ts", "event_id"], downstream=[rebuild_gold])
    q.awaitTermination()
    return read_table(spark, gold)


SQL_STREAM_CASCADE = """
SELECT event_type, COUNT(*) AS users
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 GROUP BY event_type
"""

QUERIES = {
    "stream_gold": (q_stream_gold, SQL_STREAM_GOLD),
    "stream_cascade": (q_stream_cascade, SQL_STREAM_CASCADE),
    "stream_two_sources": (q_stream_two_sources, SQL_STREAM_TWO_SOURCES),
    "stream_landing": (q_stream_landing, SQL_STREAM_LANDING),
    "stream_refresh": (q_stream_refresh, SQL_STREAM_REFRESH),
    "stream_debounce": (q_stream_debounce, SQL_DEBOUNCE),
    "stream_daily": (q_stream_daily, SQL_STREAM_DAILY),
}
