"""Landing: CSV / JSON files, envelope ids, run accounting (FIXTURES §3)."""

import json
import os

from pyspark.sql import functions as F

from tierline.sources.landing import envelope, land_csv, land_json, ENVELOPE_COLUMNS


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_payload_values_stay_text(spark, tmpdir_path):
    p = _write(tmpdir_path + "/in", "a.csv", "name,age,city\nAlice,30,NYC\nBob,25,LA\n")
    land = land_csv(spark, p, "people", "acme", "b1", "2024-01-01T00:00:00")
    rows = sorted(json.loads(r.payload)["name"] + ":" + json.loads(r.payload)["age"] for r in land.bronze.collect())
    assert rows == ["Alice:30", "Bob:25"]
    run = land.run.first()
    assert (run.records_in, run.records_out, run.records_rejected, run.status) == (2, 2, 0, "success")
    assert land.bronze.columns == ENVELOPE_COLUMNS


def test_csv_metadata_row_numbers(spark, tmpdir_path):
    p = _write(tmpdir_path + "/in", "a.csv", "user_id,value\n1,foo\n2,bar\n")
    land = land_csv(spark, p, "vals", "acme", "b1", "2024-01-01T00:00:00")
    meta = sorted((json.loads(r.metadata)["format"], json.loads(r.metadata)["row_number"],
                   json.loads(r.payload)["user_id"]) for r in land.bronze.collect())
    assert meta == [("csv", 0, "1"), ("csv", 1, "2")]


def test_csv_empty_cell_is_empty_string(spark, tmpdir_path):
    p = _write(tmpdir_path + "/in", "a.csv", "a,b\n1,\n2,x\n")
    land = land_csv(spark, p, "e", "acme", "b1", "2024-01-01T00:00:00")
    got = sorted((json.loads(r.payload)["a"], json.loads(r.payload)["b"]) for r in land.bronze.collect())
    assert got == [("1", ""), ("2", "x")]


def test_csv_empty_file(spark, tmpdir_path):
    p = _write(tmpdir_path + "/in", "a.csv", "")
    land = land_csv(spark, p, "e", "acme", "b1", "2024-01-01T00:00:00")
    run = land.run.first()
    assert (run.records_in, run.records_out, run.status) == (0, 0, "success")


def test_json_document_array_and_ndjson(spark, tmpdir_path):
    d = tmpdir_path + "/in"
    _write(d, "doc.json", '[{"id": "1", "name": "Widget", "price": 9.99},\n {"id": "2", "name": "Gadget", "price": 19.99}]')
    _write(d, "obj.json", '{\n  "id": "3",\n  "name": "Single"\n}\n')
    _write(d, "lines.json", '{"id": "4"}\n\n{"id": "5"}\n')
    land = land_json(spark, d, "items", "acme", "b1", "2024-01-01T00:00:00")
    ids = sorted(json.loads(r.payload)["id"] for r in land.bronze.collect())
    assert ids == ["1", "2", "3", "4", "5"]
    assert land.run.first().status == "success"


def test_json_bad_line_is_rejected_not_fatal(spark, tmpdir_path):
    d = _write(tmpdir_path + "/in", "lines.json", '{"id": "4"}\nnot json\n{"id": "5"}\n')
    land = land_json(spark, d, "items", "acme", "b1", "2024-01-01T00:00:00")
    run = land.run.first()
    assert (run.records_in, run.records_out, run.records_rejected, run.status) == (3, 2, 1, "partial")
    assert [r.raw for r in land.rejects.collect()] == ["not json"]


def test_envelope_ids_are_stable(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    a = envelope(df, "src", "t", "b1", "2024-01-01T00:00:00", position="k")
    b = envelope(df, "src", "t", "b1", "2024-01-01T00:00:00", position="k")
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert a.select(F.countDistinct("id")).first()[0] == 2
    assert json.loads(a.orderBy("payload").first().payload) == {"v": "a"}


def test_csv_ragged_rows_quotes_and_header_orders(spark, tmpdir_path):
    d = tmpdir_path + "/in"
    _write(d, "a.csv", 'a,b,c\n1,x,x\n2,y\n3,y,z\n4,y,z,extra\n"say ""hi"" now","line1\nline2",\n')
    _write(d, "b.csv", "b,a\n7,8\n\n9\n")
    _write(d, "c.csv", "a,a\n1,2\n")
    land = land_csv(spark, d, "r", "acme", "b1", "2024-01-01T00:00:00")
    got = sorted(r.payload for r in land.bronze.collect())
    assert got == sorted(['{"a":"1","b":"x","c":"x"}', '{"a":"2","b":"y","c":""}', '{"a":"3","b":"y","c":"z"}',
                          '{"a":"say \\"hi\\" now","b":"line1\\nline2","c":""}', '{"b":"7","a":"8"}', '{"b":"9","a":""}', '{"a":"2"}'])
    assert [(r.row_number, r.raw) for r in land.rejects.collect()] == [(3, "4,y,z,extra")]
    run = land.run.first()
    assert (run.records_in, run.records_out, run.records_rejected, run.status) == (8, 7, 1, "partial")


def test_json_mixed_files(spark, tmpdir_path):
    d = tmpdir_path + "/in"
    _write(d, "bad.json", "no json at all")
    _write(d, "lines.json", '{"z":1.0,"a":2}\n{"a":1}trailing\n{"k":1,"k":2}\n[1]\n')
    _write(d, "array.json", '[\n {"z": 1.0, "a": 2},\n "text", 5, null\n]')
    _write(d, "broken.json", '[\n {"q": 1}\n')
    land = land_json(spark, d, "items", "acme", "b1", "2024-01-01T00:00:00")
    assert sorted(r.payload for r in land.bronze.collect()) == sorted(
        ['{"z":1.0,"a":2}', '{"k":1,"k":2}', "[1]", '{"z":1.0,"a":2}', '"text"', "5", "null", '{"q": 1}'])
    assert sorted(r.raw for r in land.rejects.collect()) == ["[", "no json at all", '{"a":1}trailing']
    run = land.run.first()
    assert (run.records_in, run.records_out, run.records_rejected, run.status) == (11, 8, 3, "partial")


def test_keys_with_quotes(spark):
    from tierline.functions import jsonx

    for key in ("a'b", 'a"b', "a'b\"c", "a.b", "a b", "a]b", "back\\slash"):
        df = spark.createDataFrame([(json.dumps({key: 5, "other": {"x": 1}}),)], "p string").withColumn("v", jsonx.parse("p"))
        row = df.select(jsonx.text("p", key).alias("t"), jsonx.typed("v", key, "int").alias("i"), jsonx.strict("v", key, "int").alias("s")).first()
        assert (row.t, row.i, row.s) == ("5", 5, 5), key
        assert df.select(jsonx.typed("v", key + "'", "int").alias("i")).first().i is None


def test_is_json_takes_whole_values_only(spark):
    from tierline.functions.jsonx import is_json

    good = ["1", '"x"', "null", "[1]", '{"a": "after"}', '["after", "behind"]', ' {"a":1} ']
    bad = ["", "1]", "1] x", '1, 2', '1, "after"] x', '1,"behind"]', "{bad", '{"a":1}} x', '{"a":1} x', "[1] [2]", "}"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] for r in df.select(is_json("t")).collect()] == [True] * len(good) + [False] * len(bad)
