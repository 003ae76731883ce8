"""Paged landing rules (FIXTURES §3: single page, path, offset, cursor, cap)."""

import json

from pyspark.sql import functions as F

from tierline.sources.pages import land_pages, resolve_path


def _pages(spark, bodies, links=None):
    rows = [("p", i, f"https://x/{i}", (links or {}).get(i), json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "pull_id string, page int, url string, link_header string, body string")


def test_single_page_list(spark):
    out = land_pages(_pages(spark, [[{"a": 1}, {"a": 2}]]))
    assert out.count() == 2


def test_single_page_path(spark):
    body = {"data": {"items": [{"a": 1}, {"a": 2}]}, "meta": {"n": 2}}
    out = land_pages(_pages(spark, [body]), "", "data.items")
    assert out.count() == 2


def test_single_page_scalar_body_is_one_record(spark):
    out = land_pages(_pages(spark, [{"x": 1}]), "", "missing.path")
    assert [json.loads(r.record) for r in out.collect()] == [{"x": 1}]


def test_offset_stops_on_short_page(spark):
    bodies = [[{"a": 1}, {"a": 2}], [{"a": 3}], [{"a": 4}, {"a": 5}]]
    out = land_pages(_pages(spark, bodies), "offset", "", page_size=2, max_pages=10)
    assert out.count() == 3
    assert out.select(F.countDistinct("page")).first()[0] == 2


def test_cursor_stops_on_null_cursor(spark):
    bodies = [{"items": [{"a": 1}], "meta": {"next_cursor": "abc123"}},
              {"items": [{"a": 2}], "meta": {"next_cursor": None}},
              {"items": [{"a": 3}], "meta": {"next_cursor": "zzz"}}]
    out = land_pages(_pages(spark, bodies), "cursor", "items", max_pages=10)
    assert out.count() == 2


def test_page_cap(spark):
    bodies = [[{"a": i}] for i in range(10)]
    out = land_pages(_pages(spark, bodies), "offset", "", page_size=1, max_pages=3)
    assert out.count() == 3
    assert out.select(F.countDistinct("page")).first()[0] == 3


def test_link_header_chain_keeps_empty_pages(spark):
    bodies = [[{"a": 1}], [], [{"a": 3}], [{"a": 4}]]
    links = {0: '<https://x/1>; rel="next"', 1: '<https://x/2>; rel="next"'}
    out = land_pages(_pages(spark, bodies, links), "link_header", "")
    assert sorted(json.loads(r.record)["a"] for r in out.collect()) == [1, 3]


def test_path_helper(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":[1,2,3]}}}',)], "body string")
    r = df.select(F.to_json(resolve_path(F.col("body"), "a.b.c")).alias("abc"),
                  F.to_json(resolve_path(F.col("body"), "a.b")).alias("ab"),
                  F.to_json(resolve_path(F.col("body"), "")).alias("all"),
                  resolve_path(F.col("body"), "x.y").isNull().alias("xy_null")).first()
    assert r.abc == "[1,2,3]" and r.ab == '{"c":[1,2,3]}' and r.xy_null
    assert json.loads(r.all) == {"a": {"b": {"c": [1, 2, 3]}}}


def test_cursor_falsy_values_stop(spark):
    for stop in [0, False, "", [], {}]:
        bodies = [{"items": [{"a": 1}], "meta": {"next_cursor": stop}}, {"items": [{"a": 2}], "meta": {}}]
        assert land_pages(_pages(spark, bodies), "cursor", "items", max_pages=10).count() == 1, stop
    bodies = [{"items": [{"a": 1}], "meta": {"next_cursor": 7}}, {"items": [{"a": 2}], "meta": {}}]
    assert land_pages(_pages(spark, bodies), "cursor", "items", max_pages=10).count() == 2


def test_follow_links_by_url_ignores_page_numbers(spark):
    from tierline.sources.pages import follow_links, page_records
    # fetch order 0 -> 3 -> 1 (by url); page 2 is not linked
    bodies = {0: [{"a": 0}], 3: [{"a": 3}], 1: [], 2: [{"a": 2}]}
    links = {0: '<https://x/3>; rel="next"', 3: '<https://x/1>; rel="next"', 1: None, 2: '<https://x/0>; rel="next"'}
    rows = [("p", i, f"https://x/{i}", links[i], json.dumps(b)) for i, b in bodies.items()]
    df = spark.createDataFrame(rows, "pull_id string, page int, url string, link_header string, body string")
    got = sorted((r.page, r.hop) for r in follow_links(page_records(df), "link_header", max_pages=10).collect())
    assert got == [(0, 0), (1, 2), (3, 1)]
    capped = sorted(r.page for r in follow_links(page_records(df), "link_header", max_pages=2).collect())
    assert capped == [0, 3]
    landed = sorted(json.loads(r.record)["a"] for r in land_pages(df, "link_header", "").collect())
    assert landed == [0, 3]


def test_page_numbers_do_not_matter_to_link_chains(spark):
    from tierline.plans.landing import BASE, fetched_pages
    pages = fetched_pages(spark, "/root/testdata/sf0.001")
    turned = pages.withColumn("page", F.when(F.col("page") == 0, 0).otherwise(1000 - F.col("page")))
    for strategy, kw in (("link_header", {}), ("next_url", {"base_url": BASE})):
        a = {(r.pull_id, r.url, r.item_pos) for r in land_pages(pages, strategy, "data.items", **kw).collect()}
        b = {(r.pull_id, r.url, r.item_pos) for r in land_pages(turned, strategy, "data.items", **kw).collect()}
        assert a == b and len(a) > 0


def test_links_are_followed_by_url_whatever_the_page_numbers(spark):
    links = {4: '<https://x/2>; rel="next"', 2: '<https://x/9>; rel="next"', 9: '<https://x/4>; rel="next"'}
    rows = [("p", n, f"https://x/{i}", links.get(i), json.dumps([{"a": i}])) for n, i in ((1, 4), (2, 9), (3, 2), (4, 7))]
    df = spark.createDataFrame(rows, "pull_id string, page int, url string, link_header string, body string")
    got = sorted(json.loads(r.record)["a"] for r in land_pages(df, "link_header").collect())
    assert got == [2, 4, 9]                 # a cycle ends the chain; page 4 is not linked
    assert land_pages(df, "link_header", max_pages=None, max_records=None).count() == 3
    assert land_pages(df, "link_header", max_records=2).count() == 2


def test_pull_report_tells_what_a_bound_cut(spark):
    from tierline.sources.pages import pull_report
    df = _pages(spark, [[{"a": i}] for i in range(6)])
    row = lambda **kw: tuple(pull_report(df, "offset", page_size=1, **kw).first())[1:]
    assert row(max_pages=4) == (6, 4, True) and row(max_pages=6) == (6, 6, False)
    assert row(max_records=2) == (6, 2, True) and row(max_pages=None, max_records=None) == (6, 6, False)


def test_single_page_is_the_first_one(spark):
    df = _pages(spark, [[{"a": 1}], [{"a": 2}]]).withColumn("page", F.col("page") + 1)
    assert [json.loads(r.record)["a"] for r in land_pages(df).collect()] == [1]
