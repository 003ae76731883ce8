"""Headline timings: one warm-up, median of three runs per query, seconds.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8) and prints one JSON line.  Bronze tables
and the upsert target are written before the clock starts, so a query is timed
without the cost of making its input.  Every query is forced with a ``noop``
write (the upserts with their own write), so the whole plan runs but nothing is
collected to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tierline.plans import common, core, inference, lineage, recall, reports  # noqa: E402
from tierline.plans.common import table  # noqa: E402
from tierline.session import get_session, scratch_dir  # noqa: E402
from tierline.sources.sinks import upsert_table, with_bucket  # noqa: E402


def staged(df, path):
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def inputs(spark, sf_dir):
    """What the timed queries read, landed outside the clock."""
    root = scratch_dir(spark, "bench")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    target = f"{root}/silver"
    upsert_table(spark, target, o, "o_orderkey", n_buckets=64)
    return {"flat": staged(core.bronze_table(spark, sf_dir, "orders", "o_orderkey"), f"{root}/flat"),
            "orders": staged(core.bronze_orders(spark, sf_dir), f"{root}/orders"),
            "nested": staged(core.orders_with_items(spark, sf_dir), f"{root}/nested"), "target": target, "rows": o}


def upsert_share(held, buckets: range):
    """Orders of the given hash buckets upserted into the bucketed silver
    table: one bucket of 64 is about 1.6 % of the keys and of the table."""
    spark = held["rows"].sparkSession
    batch = (with_bucket(held["rows"], "o_orderkey", 64).filter(F.col("_bucket").isin(list(buckets))).drop("_bucket")
             .withColumn("o_totalprice", F.col("o_totalprice") * 1.01))
    upsert_table(spark, held["target"], batch, "o_orderkey", order_by=["o_orderdate"])


QUERIES = {
    "envelope_landing": lambda s, d, h: core.bronze_orders(s, d),
    "flatten": lambda s, d, h: core.flattened_orders(h["flat"]),
    "unnest": lambda s, d, h: core.unnested_line_items(h["nested"]),
    "upsert_1pct": lambda s, d, h: upsert_share(h, range(1)),
    "upsert_100pct": lambda s, d, h: upsert_share(h, range(64)),
    "daily_revenue": lambda s, d, h: core.q_revenue_by_day_segment(s, d),
    "daily_stats": lambda s, d, h: reports.q_daily_stats(s, d),
    "field_inference": lambda s, d, h: inference.inferred_orders(h["orders"]),
    "lineage_edges": lambda s, d, h: lineage.q_lineage_edges(s, d),
    "recall_topk": lambda s, d, h: recall.q_recall_topk(s, d),
}


def run(df):
    if df is not None:
        df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = get_session(f"local[{cpus}]", app="tierline-bench", shuffle_partitions=cpus * 2,
                        extra={"spark.driver.memory": "16g",
                               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m"})
    # the bench files hold one row group each: deal their rows to all cores
    common.SPREAD_SMALL_FILES = True
    held = inputs(spark, sf_dir)
    times = {}
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        run(fn(spark, sf_dir, held))                     # warm-up
        runs = []
        for _ in range(3):
            t0 = time.perf_counter()
            run(fn(spark, sf_dir, held))
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
