"""Lineage walks, cascade cap, debounce, bounded results."""

import pytest
from pyspark.sql import functions as F

from tierline.operators import lineage as L
from tierline.operators import query as Q


def test_upstream_with_cycle_terminates(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")],
                              "source_entity_id string, target_entity_id string")
    roots = spark.createDataFrame([("c",)], "id string")
    got = {(r.node, r.depth) for r in L.upstream(e, roots).collect()}
    assert got == {("b", 1), ("x", 1), ("a", 2)}


def test_resolution_rules(spark):
    ents = spark.createDataFrame([("e1", "t", "orders", "bronze"), ("e2", "t", "orders", "silver"),
                                  ("e3", "t", "summary", "gold"), ("e4", "t", "items", "silver")],
                                 "id string, tenant_id string, name string, layer string")
    tr = spark.createDataFrame([
        ("t1", "t", "bronze", "silver", "INSERT OR REPLACE INTO silver.orders SELECT * FROM bronze.orders"),
        ("t2", "t", "silver", "gold",
         "CREATE OR REPLACE TABLE gold.summary AS SELECT * FROM orders o JOIN items i ON o.k = i.k"),
        ("t3", "t", "silver", "gold", "SELECT 1 FROM nowhere")],
        "id string, tenant_id string, source_layer string, target_layer string, transform_sql string")
    r = {x.id: (x.target_id, x.source_ids) for x in L.resolve(tr, ents).collect()}
    assert r["t1"] == ("e2", ["e1"])
    assert r["t2"] == ("e3", ["e2", "e4"])          # silver preferred below a gold target
    assert r["t3"] == ("e3", [])                   # only gold entity -> singleton fallback
    edges = {(x.transform_id, x.source_entity_id, x.target_entity_id) for x in L.edges(L.resolve(tr, ents)).collect()}
    assert ("t3", None, "e3") in edges and ("t2", "e4", "e3") in edges


def test_cascade_depth_cap(spark):
    # chain e0 -> t0 -> e1 -> t1 -> ... each transform watches the previous entity
    n = 8
    tr = spark.createDataFrame([(f"t{i}", "t", "approved", "on_change", f'["e{i}"]') for i in range(n)],
                               "id string, tenant_id string, status string, trigger_mode string, watch_entities string")
    res = spark.createDataFrame([(f"t{i}", "t", f"e{i + 1}") for i in range(n)],
                                "id string, tenant_id string, target_id string")
    changed = spark.createDataFrame([("e0", "t")], "id string, tenant_id string")
    plan = sorted((r.transform_id, r.depth) for r in L.cascade_plan(tr, res, changed).collect())
    assert plan == [(f"t{i}", i) for i in range(5)]


def test_debounce(spark):
    ts = [0, 10, 35, 50, 80]
    df = spark.createDataFrame([(1, i, f"2024-01-01 00:00:{t // 60:02d}".replace(":00:", ":%02d:" % (t // 60))
                                 + "") for i, t in enumerate(ts)], "k long, id long, s string")
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "k long, id long, sec long") \
        .withColumn("ts", F.timestamp_seconds(F.col("sec") + 1704067200).cast("timestamp_ntz"))
    fired = sorted(r.sec for r in L.debounce(df, "k", "ts", "id").collect())
    assert fired == [0, 35, 80]


def test_debounce_across_day_boundary(spark):
    base = 1704153600 - 20      # 20 s before midnight
    secs = [0, 15, 25, 40, 45]  # crosses midnight inside a burst
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(secs)], "k long, id long, sec long") \
        .withColumn("ts", F.timestamp_seconds(F.col("sec") + base).cast("timestamp_ntz"))
    assert sorted(r.sec for r in L.debounce(df, "k", "ts", "id").collect()) == [0, 40]


def test_bounded_and_paging(spark):
    df = spark.range(0, 1200).withColumnRenamed("id", "k")
    b = Q.bounded(df, ["k"])
    assert b.count() == 500 and b.first().truncated is True
    small = Q.bounded(spark.range(0, 10).withColumnRenamed("id", "k"), ["k"])
    assert small.count() == 10 and not small.first().truncated
    assert [r.k for r in Q.page(df, ["k"], 3, 5).collect()] == [10, 11, 12, 13, 14]
    assert Q.capped(df, ["k"], 1000).count() == 1000 and Q.capped(df, ["k"]).count() == 20
    assert Q.capped(df, ["k"], 1100, most=None).count() == 1100
    for asked in (lambda: Q.capped(df, ["k"], 5000), lambda: Q.preview(df, ["k"], 101), lambda: Q.page(df, ["k"], 1, 201),
                  lambda: Q.page(df, ["k"], 0, 5)):
        with pytest.raises(ValueError):
            asked()


def test_top_k_per_group_hot_key(spark):
    # one key holds most rows; result is exact
    rows = [(0, i) for i in range(2000)] + [(1, i) for i in range(10)]
    df = spark.createDataFrame(rows, "g long, v long")
    out = Q.top_k_per_group(df, ["g"], [F.col("v").desc()], 3, salt_buckets=16)
    assert sorted((r.g, r.rank, r.v) for r in out.collect()) == \
        [(0, 1, 1999), (0, 2, 1998), (0, 3, 1997), (1, 1, 9), (1, 2, 8), (1, 3, 7)]


def test_debounce_long_bursts_match_fold(spark):
    """The pointer-doubling path for long bursts equals the fold."""
    import random
    rnd = random.Random(7)
    rows, t = [], 0
    for i in range(400):
        t += rnd.choice([1, 3, 7, 12, 20, 29, 31, 45, 90])
        rows.append((i % 3, i, t))
    df = spark.createDataFrame(rows, "k long, id long, sec long") \
        .withColumn("ts", F.timestamp_seconds(F.col("sec") + 1704067200).cast("timestamp_ntz"))
    folded = sorted((r.k, r.id) for r in L.debounce(df, "k", "ts", "id").collect())
    jumped = sorted((r.k, r.id) for r in L.debounce(df, "k", "ts", "id", fold_limit=0).collect())
    assert folded == jumped and len(folded) > 0
    # brute force
    want = []
    for k in range(3):
        last = None
        for (kk, i, s) in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if last is None or s - last >= 30:
                last = s
                want.append((k, i))
    assert folded == sorted(want)
