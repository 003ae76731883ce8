"""Gold tables by deltas against full rebuilds."""

import os
import random

import pytest

from tierline.operators import gold
from tierline.sources.sinks import read_changes, upsert_table

SCHEMA = "id long, g string, h int, x double, gone boolean"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


@pytest.mark.parametrize("seed", [1, 2])
def test_gold_equals_a_rebuild_after_every_batch(spark, tmpdir_path, seed):
    rng = random.Random(seed)
    silver, table = tmpdir_path + "/silver", tmpdir_path + "/gold"
    for epoch in range(5):
        batch = [(rng.randrange(40), rng.choice(["a", "b", None, "it's"]), rng.choice([None, 1, 2]), rng.choice([None, 0.1, 0.2, 1e9, -3.5]),
                  rng.choice([None, False, False, True])) for _ in range(30)]
        if epoch == 3:
            batch = [(i, None, None, None, True) for i in range(40)]                # all keys go
        df = spark.createDataFrame(batch, SCHEMA)
        log = f"{tmpdir_path}/log/{epoch}"
        for attempt in range(2):                                                    # each call twice, as after a failure
            upsert_table(spark, silver, df, "id", 4, order_by=["x", "g", "h", "gone"], deleted="gone", log=log)
            change = gold.delta(read_changes(spark, log), ["g", "h"], ["x"])
            gold.apply(spark, table, change, ["g", "h"], epoch, 4)
        now = spark.read.schema(df.drop("gone").schema).parquet(silver)
        assert _rows(gold.read(spark, table, ["g", "h"], ["x"])) == _rows(gold.rebuilt(now, ["g", "h"], ["x"]))
        assert (now.count() == 0) == (epoch == 3)


def test_gold_changes_only_touched_groups_and_finishes_a_failed_run(spark, tmpdir_path):
    silver, table = tmpdir_path + "/silver", tmpdir_path + "/gold"
    put = lambda rows, epoch: upsert_table(spark, silver, spark.createDataFrame(rows, SCHEMA), "id", 4, deleted="gone", log=f"{tmpdir_path}/log/{epoch}")
    delta = lambda epoch: gold.delta(read_changes(spark, f"{tmpdir_path}/log/{epoch}"), ["g"], ["x"])
    put([(i, f"g{i}", 0, 1.0, False) for i in range(20)], 0)
    gold.apply(spark, table, delta(0), ["g"], 0, 8)
    before = _files(table)
    put([(3, "g3", 0, 5.0, False), (4, "g4", 0, 1.0, False)], 1)                    # 4 is as it was
    assert [r.g for r in delta(1).collect()] == ["g3"]
    gold.apply(spark, table, delta(1), ["g"], 1, 8)
    after = _files(table)
    assert len([f for f in before if f in after]) >= len(before) - 1
    put([(5, "g6", 0, 1.0, False), (7, "g7", 0, None, True)], 2)
    half = delta(2).where("g = 'g5'")                                               # a run that failed after one group
    gold.apply(spark, table, half, ["g"], 2, 8)
    gold.apply(spark, table, delta(2), ["g"], 2, 8)
    got = {r.g: (r.n_rows, float(r.x_sum)) for r in gold.read(spark, table, ["g"], ["x"]).collect()}
    want = {f"g{i}": (1, 1.0) for i in range(20)} | {"g3": (1, 5.0), "g6": (2, 2.0)}
    assert got == {g: v for g, v in want.items() if g not in ("g5", "g7")}
