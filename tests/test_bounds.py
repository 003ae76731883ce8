"""Deep pages, row numbers, bounds of pulls, quoted names."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tierline.operators import charts
from tierline.operators import query as Q
from tierline.sources.pages import land_pages, pull_report, resolve_path


def _sample(spark, n=3000):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(20)]), rng.random(), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "a int, b double, i int").repartition(7)


@pytest.mark.parametrize("offset,size", [(0, 5), (2990, 200), (1234, 77), (2999, 1), (3000, 10), (9999, 3), (0, 3000)])
def test_deep_page_equals_a_sort(spark, offset, size):
    rows, df = _sample(spark)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))[offset:offset + size]
    got = Q.deep_page(df, [F.col("a").asc_nulls_first(), F.col("b").desc()], offset, size).collect()
    assert [r.i for r in got] == [r[2] for r in want]


def test_page_goes_by_ranges_when_deep(spark, monkeypatch):
    rows, df = _sample(spark)
    monkeypatch.setattr(Q, "SHALLOW_ROWS", 100)
    assert [r.i for r in Q.page(df, ["i"], 150, 20).collect()] == list(range(2980, 3000))
    assert [r.i for r in Q.page(df, ["i"], 2, 20).collect()] == list(range(20, 40))


def test_number_rows_is_a_row_number(spark):
    rows, df = _sample(spark)
    got = {r.i: r.n for r in Q.number_rows(df, ["b", "i"], "n").collect()}
    assert got == {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])))}
    assert Q.number_rows(df.where("i < 0"), ["i"], "n").count() == 0


def test_pulls_have_no_bound_unless_named(spark):
    rows = [(1, p, f"u{p}", None, json.dumps([{"n": 1000 * p + k} for k in range(400)])) for p in range(150)]
    df = spark.createDataFrame(rows, "pull_id long, page long, url string, link_header string, body string")
    assert land_pages(df, "offset", page_size=400).count() == 150 * 400
    assert tuple(pull_report(df, "offset", page_size=400).first())[1:] == (150, 150, False)
    assert land_pages(df, "offset", page_size=400, max_pages=100).count() == 100 * 400


def test_paths_with_quotes(spark):
    df = spark.createDataFrame([('{"it\'s": {"x": 5, "y\'z": [1]}}',), ('{"a": 1}',), ("[1]",), ("bad",), (None,)], "body string")
    read = lambda p: [r[0] for r in df.select(F.to_json(resolve_path(F.col("body"), p))).collect()]
    assert read("it's.x") == ["5", None, None, None, None]
    assert read("$.it's.y'z") == ["[1]", None, None, None, None]
    assert read("no'where.x") == [None] * 5


def test_profile_of_quoted_names_in_one_pass(spark):
    names = ["it's", "a`b", 'say "hi"', "plain"]
    df = spark.createDataFrame([(str(i % 25), str(i % 26), str(i), "x" if i % 2 else "") for i in range(300)], names)
    out = {r["name"]: r for r in charts.profile_columns(df).collect()}
    assert list(out) and {n: out[n].categorical for n in names} == {"it's": True, "a`b": False, 'say "hi"': False, "plain": False}
    assert charts.profile_columns(df)._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    nothing = charts.profile_columns(df.where("plain = 'none'")).collect()
    assert all(not r.categorical for r in nothing)


def test_renest_spreads_a_hot_parent(spark):
    from tierline.functions import jsonx

    rng = random.Random(2)
    rows = [(0 if i % 3 else rng.randrange(50), rng.choice([None, rng.randrange(10 ** 6)]) if i % 50 == 0 else i, f'v"{i % 7}') for i in range(4000)]
    df = spark.createDataFrame(rows, "p int, o int, v string").repartition(5)
    got = {r.p: json.loads(r["items"]) for r in jsonx.renest(df, ["p"], ["v"], "o").collect()}
    want = {}
    for p, o, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(p, []).append({"o": o, "v": v})
    assert got == want
    ranged = df.repartitionByRange(8, "p", "o").withColumn("part", F.spark_partition_id())
    assert ranged.where("p = 0").select("part").distinct().count() > 3
