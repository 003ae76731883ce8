"""Type lattice and PII rules."""

import json

from pyspark.sql import functions as F

from tierline.functions.pii import mask_for
from tierline.operators.infer import infer_fields


def _types(spark, records):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "pos long, payload string")
    return {r.name: (r.data_type, r.nullable, r.is_pii) for r in infer_fields(df, "pos").collect()}


def test_lattice(spark):
    t = _types(spark, [
        {"id": 299, "code": "299", "n": "12", "f": "1.5", "x": "+1", "u": "1_000", "nan": "nan", "b": True,
         "ts": "2024-01-01T10:00:00Z", "d": "2024-01-01", "e": "a@b.co", "url": "https://x.y/z", "arr": [1],
         "obj": {"a": 1}, "mixed": 1, "uuid": "123e4567-e89b-12d3-a456-426614174000", "num": 1},
        {"id": 300, "code": "300", "n": "13", "f": "2", "x": "-2", "u": "7", "nan": "inf", "b": False,
         "ts": "2024-01-02 11:00", "d": "2024-02-01", "e": "c@d.org", "url": "http://q", "arr": [],
         "obj": {}, "mixed": "a", "uuid": "123e4567-e89b-12d3-a456-426614174001", "num": 2.5},
    ])
    assert t["id"][0] == "int"                 # JSON numbers are typed before text rules
    assert t["code"][0] == "string"            # identifier name: no numeric coercion of text
    assert t["n"][0] == "int"
    assert t["f"][0] == "float"
    assert t["x"][0] == "int" and t["u"][0] == "int" and t["nan"][0] == "float"
    assert t["b"][0] == "bool"
    assert t["ts"][0] == "timestamp" and t["d"][0] == "timestamp"
    assert t["e"][0] == "string" and t["url"][0] == "string"
    assert t["arr"][0] == "array" and t["obj"][0] == "json"
    assert t["mixed"][0] == "string"
    assert t["uuid"][0] == "string"
    assert t["num"][0] == "float"


def test_nullable_and_pii(spark):
    t = _types(spark, [{"contact_id": "1", "first_name": "A", "email": "a@b.c", "phone": "1"},
                       {"contact_id": "2", "first_name": "B", "email": "b@b.c"},
                       {"contact_id": "3", "first_name": None, "email": "c@b.c", "phone": None}])
    assert t["phone"][1] is True and t["first_name"][1] is True and t["email"][1] is False
    assert t["email"][2] and t["first_name"][2] and t["phone"][2] and not t["contact_id"][2]


def test_first_seen_order_and_samples(spark):
    df = spark.createDataFrame([(0, '{"b": 1, "a": 2}'), (1, '{"c": [1,2], "a": 3}'), (2, '{"a": 4, "b": null}'),
                                (3, '{"a": 5}')], "pos long, payload string")
    f = {r.name: (r.ordinal, r.samples) for r in infer_fields(df, "pos").collect()}
    assert f["b"] == (0, ["1"]) and f["a"] == (1, ["2", "3", "4"]) and f["c"] == (2, ["[1,2]"])


def test_masks(spark):
    df = spark.createDataFrame([("j.doe@example.com", "+44 7700 900123", "Jane  Doe", "x", "12", "@x.com")],
                               "email string, phone string, full_name string, ssn string, mobile string, "
                               "work_email string")
    r = df.select(*[mask_for(c).alias(c) for c in df.columns]).first()
    assert r.email == "j***@example.com"
    assert r.phone == "***-***-0123"
    assert r.full_name == "J*** D***"
    assert r.ssn == "[REDACTED]"
    assert r.mobile == "***"
    assert r.work_email == "***@x.com"
    n = spark.createDataFrame([(None,)], "email string").select(mask_for("email").alias("m")).first()
    assert n.m is None
    noat = spark.createDataFrame([("nobody",)], "email string").select(mask_for("email").alias("m")).first()
    assert noat.m == "***"
