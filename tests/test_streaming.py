"""Streaming debounce across micro-batches and streaming refresh."""

import os

from pyspark.sql import functions as F

from tierline.streaming import streams as S


def test_debounce_stream_across_batches(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    base = 1704067200
    for i, secs in enumerate([[0, 10], [35, 50], [80]]):
        df = spark.createDataFrame([(1, 10 * i + j, s) for j, s in enumerate(secs)], "k long, id long, sec long") \
            .withColumn("ts", F.timestamp_seconds(F.col("sec") + base).cast("timestamp_ntz")).drop("sec")
        df.coalesce(1).write.mode("append").parquet(src)
        # distinct modification times keep file order = batch order
        import time
        time.sleep(1.1)
    schema = spark.read.parquet(src).schema
    q = S.debounce_stream(spark, src, schema, "k", "ts", "id", tmpdir_path + "/out", tmpdir_path + "/ck",
                          max_files=1)
    q.awaitTermination()
    fired = sorted(r.fired_us // 1_000_000 - base for r in spark.read.parquet(tmpdir_path + "/out").collect())
    assert fired == [0, 35, 80]


def test_refresh_stream_upserts(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "bronze")
    spark.createDataFrame([('{"id": "a", "v": 1}', "1"), ('{"id": "b", "v": 2}', "2")], "payload string, o string") \
        .write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    q = S.refresh_stream(spark, src, schema, [("id", "string"), ("v", "int")], "id", tmpdir_path + "/silver",
                         tmpdir_path + "/ck", n_buckets=4, order_by=["v"])
    q.awaitTermination()
    spark.createDataFrame([('{"id": "a", "v": 5}', "3")], "payload string, o string").write.mode("append").parquet(src)
    q = S.refresh_stream(spark, src, schema, [("id", "string"), ("v", "int")], "id", tmpdir_path + "/silver",
                         tmpdir_path + "/ck", n_buckets=4, order_by=["v"])
    q.awaitTermination()
    got = {r.id: r.v for r in spark.read.parquet(tmpdir_path + "/silver").collect()}
    assert got == {"a": 5, "b": 2}


def test_land_stream_json_lines(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as fh:
        fh.write('{"z": 1.0, "a": 2}\nnot json\n\n{"id": 2, "v": "y"}\n{"id": 2, "v": "y"}\n{"id": 3} tail\n')
    q = S.land_stream(spark, src, None, tmpdir_path + "/bronze", tmpdir_path + "/ck", "hook", "t0", None,
                      ingested_at="2024-02-01T00:00:00", fmt="text")
    q.awaitTermination()
    b = spark.read.parquet(tmpdir_path + "/bronze")
    assert [r.payload for r in b.orderBy("id").collect()] == ['{"z": 1.0, "a": 2}', '{"id": 2, "v": "y"}', '{"id": 2, "v": "y"}']
    assert b.select("id").distinct().count() == 3 and str(b.first().ingest_date) == "2024-02-01"
    bad = spark.read.parquet(tmpdir_path + "/bronze_rejects")
    assert sorted((r.row_number, r.raw) for r in bad.collect()) == [(1, "not json"), (5, '{"id": 3} tail')]


def test_debounce_stream_keeps_key_types(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    rows = [("a", "e1", 0), ("a", "e2", 29), ("a", "e3", 30), ("b", "e4", 5), ("a", "e5", 61), ("a", "e6", 60)]
    rows = [(k, i, 1704067200 + s) for k, i, s in rows]
    spark.createDataFrame(rows, "k string, id string, sec long").withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")) \
        .drop("sec").coalesce(1).write.parquet(src)
    S.debounce_stream(spark, src, spark.read.parquet(src).schema, "k", "ts", "id", tmpdir_path + "/out", tmpdir_path + "/ck").awaitTermination()
    assert sorted((r.key, r.event_id) for r in spark.read.parquet(tmpdir_path + "/out").collect()) == [
        ("a", "e1"), ("a", "e3"), ("a", "e6"), ("b", "e4")]


def _lines(path, name, first, n=5):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as fh:
        fh.writelines('{"n": %d}\n' % i for i in range(first, first + n))


def test_streams_share_a_sink_and_replays_keep_all_rows(spark, tmpdir_path):
    sink = tmpdir_path + "/bronze"
    run = lambda src, ck, fmt="text", schema=None, pos=None: S.land_stream(
        spark, f"{tmpdir_path}/{src}", schema, sink, f"{tmpdir_path}/{ck}", src, "t0", pos, ingested_at="2024-02-01T00:00:00", fmt=fmt).awaitTermination()
    payloads = lambda: sorted(r.payload.replace(" ", "") for r in spark.read.parquet(sink).collect())
    want = lambda *firsts: sorted('{"n":%d}' % i for f in firsts for i in range(f, f + 5))
    _lines(f"{tmpdir_path}/one", "a.json", 0)
    _lines(f"{tmpdir_path}/two", "a.json", 100)
    spark.range(200, 205).withColumnRenamed("id", "n").write.parquet(f"{tmpdir_path}/three")
    spark.range(300, 305).withColumnRenamed("id", "n").write.parquet(f"{tmpdir_path}/four")
    run("one", "ck1")
    run("two", "ck2")
    assert payloads() == want(0, 100)
    schema = spark.read.parquet(f"{tmpdir_path}/three").schema
    run("three", "ck3", "parquet", schema, "n")
    run("four", "ck4", "parquet", schema, "n")
    assert payloads() == want(0, 100, 200, 300)
    # a batch that was written but not committed is replayed, in both forms
    for ck, src, extra in (("ck1", "one", ()), ("ck3", "three", ("parquet", schema, "n"))):
        commits = f"{tmpdir_path}/{ck}/commits"
        for f in os.listdir(commits):
            os.remove(os.path.join(commits, f))
        run(src, ck, *extra)
    assert payloads() == want(0, 100, 200, 300)
    _lines(f"{tmpdir_path}/one", "b.json", 400)
    run("one", "ck1")
    _lines(f"{tmpdir_path}/five", "a.json", 500)
    run("five", "ck5")
    assert payloads() == want(0, 100, 200, 300, 400, 500)
    assert spark.read.parquet(sink).select("stream").distinct().count() == 5


def _fired(events):
    """Event numbers that fire, by key and time."""
    last, out = {}, []
    for k, t, i in sorted(events, key=lambda e: (e[1], e[2])):
        if k not in last or t - last[k] >= 30:
            out.append(i)
            last[k] = t
    return sorted(out)


def _stream_files(spark, path, files):
    import time

    for rows in files:
        (spark.createDataFrame([(k, i, 1704067200 + t) for k, t, i in rows], "k string, id long, sec long")
         .withColumn("ts", F.timestamp_seconds("sec").cast("timestamp_ntz")).drop("sec").coalesce(1).write.mode("append").parquet(path))
        time.sleep(1.1)
    return spark.read.parquet(path).schema


def test_debounce_of_shuffled_batches_equals_the_batch_result(spark, tmpdir_path):
    import random

    rng = random.Random(8)
    events = [(rng.choice("aaab"), rng.randrange(2000), i) for i in range(300)]
    src = tmpdir_path + "/src"
    schema = _stream_files(spark, src, [events[n::4] for n in range(4)])
    S.debounce_stream(spark, src, schema, "k", "ts", "id", tmpdir_path + "/out", tmpdir_path + "/ck", max_files=1, lateness="2000 seconds").awaitTermination()
    # the watermark has passed none of them yet
    assert sorted(r.event_id for r in S.debounce_pending(spark, tmpdir_path + "/ck").collect()) == _fired(events)
    # a far event moves the watermark past all of them
    _stream_files(spark, src, [[("z", 90_000, 1000)]])
    S.debounce_stream(spark, src, schema, "k", "ts", "id", tmpdir_path + "/out", tmpdir_path + "/ck", max_files=1, lateness="2000 seconds").awaitTermination()
    out = spark.read.parquet(tmpdir_path + "/out")
    assert out.where("late").count() == 0 and sorted(r.event_id for r in out.collect()) == _fired(events)
    assert [r.event_id for r in S.debounce_pending(spark, tmpdir_path + "/ck").collect()] == [1000]


def test_debounce_late_rows_are_kept_and_new_keys_fire(spark, tmpdir_path):
    src = tmpdir_path + "/src"
    schema = _stream_files(spark, src, [[("a", 0, 1), ("a", 1000, 2)], [("a", 500, 3), ("new", 10, 4), ("new", 100, 5)], [("a", 1031, 6), ("new", 50, 7), ("a", 700, 8)]])
    S.debounce_stream(spark, src, schema, "k", "ts", "id", tmpdir_path + "/out", tmpdir_path + "/ck", max_files=1).awaitTermination()
    got = {(r.event_id, r.late) for r in spark.read.parquet(tmpdir_path + "/out").collect()}
    assert got == {(1, False), (2, False), (4, False), (5, False), (6, False), (3, False), (7, True), (8, True)}
