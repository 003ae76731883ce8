"""Imports and stored transforms."""

import json

import pytest

from tierline.operators import flatten as fl
from tierline.operators import imports as I
from tierline.sources import sinks


def _run(spark, tmp, sql, tables=None, **more):
    return fl.run_transform(spark, {"id": "t", "status": "approved", "transform_sql": sql, **more}, tables or {}, tmp, "t0")


def _import(spark, root, rows, batch="b1", **options):
    df = spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r, n) for n, r in enumerate(rows)], "payload string, n long")
    return I.import_records(spark, df, "My Source", "t0", root, batch, "2024-01-01T00:00:00", position="n", **options)


def test_import_registers_once_and_runs(spark, tmpdir_path):
    rows = [{"id": 1, "it's": "a", "ID": "x", "a`b": 2.5, "n": True}, {"id": 2, "it's": None, "ID": "y", "a`b": 1, "n": False}, "no json", "[1]"]
    for batch in ("b1", "b2"):
        got = _import(spark, tmpdir_path, rows, batch)
    assert got.landing.run.first().records_rejected == 2
    assert {(r.id, r.n_records) for r in I.control_table(spark, tmpdir_path, "entities").collect()} == {
        ("t0.bronze.my_source", 4), ("t0.silver.my_source", None)}
    fields = I.control_table(spark, tmpdir_path, "fields").collect()
    assert sorted(r.name for r in fields if ".bronze." in r.entity_id) == sorted(["id", "it's", "ID", "a`b", "n"])
    assert sorted(r.name for r in fields if ".silver." in r.entity_id) == sorted(["id", "it's", "ID_2", "a`b", "n"])
    draft = got.transform.collect()
    assert len(draft) == 1 and draft[0].watch_entities == ["t0.bronze.my_source"] and draft[0].trigger_mode == "on_change"
    bronze = sinks.read_bronze(spark, sinks.layer_path(tmpdir_path, "t0", "bronze", "my_source"))
    out = _run(spark, tmpdir_path, draft[0].transform_sql, {"bronze.my_source": bronze}, key=draft[0].key)
    assert out.run.first().error_detail is None
    assert sorted((r["id"], r["it's"], r["ID_2"], r["a`b"], r["n"]) for r in out.output.collect()) == [(1, "a", "x", 2.5, True), (2, None, "y", 1.0, False)]


def test_import_options_and_what_is_there_already(spark, tmpdir_path):
    got = _import(spark, tmpdir_path, [{"id": 1, "code": "a"}], skip_transform=True)
    assert got.transform is None and [r.layer for r in I.control_table(spark, tmpdir_path, "entities").collect()] == ["bronze"]
    got = _import(spark, tmpdir_path, [{"id": 1, "code": "a", "more": 1}], "b2", key="code")
    assert got.transform.first().key == "code" and [r.name for r in got.fields.filter("is_pk").collect()] == ["code"] * 2
    with pytest.raises(ValueError):
        _import(spark, tmpdir_path, [{"id": 1}], "b3", key="nothing")
    approved = I.control_table(spark, tmpdir_path, "transforms").selectExpr("* EXCEPT (status, transform_sql)", "'approved' AS status", "'kept' AS transform_sql")
    I._put(spark, tmpdir_path, "transforms", approved, "id")
    got = _import(spark, tmpdir_path, [{"id": 1, "code": "a"}], "b4")
    assert [(r.status, r.transform_sql) for r in got.transform.collect()] == [("approved", "kept")]
    # a field that the newest batch has not got is not listed any more
    assert sorted(r.name for r in got.fields.filter("entity_id = 't0.bronze.my_source'").collect()) == ["code", "id"]


def test_flatten_of_keys_that_differ_in_case(spark):
    bronze = spark.createDataFrame([('{"A": 1, "a": 2, "b.c": "x"}', "1"), ('{"A": 3, "a": 4}', "2")], "payload string, id string")
    out = fl.flatten(bronze, [("A", "int"), ("a", "int"), ("b.c", "string")], "a")
    assert out.columns == ["A", "a_2", "b.c"] and sorted(tuple(r) for r in out.collect()) == [(1, 2, "x"), (3, 4, None)]
    assert fl.column_names(["x", "X", "x_2", "X"]) == ["x", "X_3", "x_2", "X_4"]


def test_statement_forms(spark, tmpdir_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    t = {"bronze.x": rows}
    sql = ("-- it's; fine\nCREATE TABLE IF NOT EXISTS silver.x (id BIGINT PRIMARY KEY, v VARCHAR(9), `w;` DECIMAL(9, 2)); /* ' ; */\n"
           "INSERT OR REPLACE INTO silver.x (id, v) SELECT id, concat(v, '\\';--') FROM bronze.x -- ; '")
    for _ in range(2):
        got = _run(spark, tmpdir_path, sql, t)
        assert got.run.first().error_detail is None
    assert sorted(tuple(r) for r in got.output.collect()) == [(1, "a';--", None), (2, "b';--", None)]
    assert [f.dataType.simpleString() for f in got.output.schema] == ["bigint", "string", "decimal(9,2)"]
    read = _run(spark, tmpdir_path, "SELECT max(id) AS m FROM bronze.x;", t)
    assert read.output.first().m == 2 and (read.run.first().status, read.run.first().rows_produced) == ("success", 0)
    temp = _run(spark, tmpdir_path, "CREATE TEMP TABLE silver.t AS SELECT id FROM bronze.x; CREATE OR REPLACE TABLE gold.n AS SELECT count(*) AS n FROM silver.t", t)
    assert temp.output.first().n == 2
    for bad in ("DROP TABLE silver.x", "DELETE FROM silver.x", "INSERT INTO silver.x SELECT 1", "INSERT INTO silver.x (id, nothing) SELECT 1, 2",
                "CREATE TABLE silver.x (id INT)", "CREATE TABLE gold.y (id NOSUCHTYPE)", "CREATE TABLE gold.y (a b c d)", "", "-- only a comment",
                "SELECT reflect('java.lang.System', 'exit', 1) FROM bronze.x", "UPDATE silver.x SET id = 1; SELECT 1"):
        assert _run(spark, tmpdir_path, bad, t).run.first().status == "failed", bad


def test_one_call_import_reads_its_table_once(spark, tmpdir_path):
    """What the query returns comes from the landed rows, not from the table again."""
    from tierline.plans.storage import q_one_call_import

    (spark.range(20).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 3 AS user_id", "'view' AS event_type",
                                "id / 4 AS value", "'{}' AS props").write.parquet(f"{tmpdir_path}/events.parquet"))
    out = q_one_call_import(spark, tmpdir_path)
    assert sorted((r.event_id, r.value) for r in out.collect()) == [(n, round(n / 4, 2)) for n in range(20)]
    assert not [f for f in out.inputFiles() if "events.parquet" in f]
