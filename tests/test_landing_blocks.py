"""CSV and JSON landing of split files against Python's own readers."""

import csv
import io
import json
import os
import random

import pytest

from tierline.sources import blocks
from tierline.sources.landing import land_csv, land_json


@pytest.fixture(params=[(64, 4), (1 << 20, 1 << 16)])
def split(spark, request, monkeypatch):
    """Files in many splits and blocks, and in one."""
    size, block = request.param
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr("tierline.sources.landing.BLOCK", block)
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield size
    for k, v in before.items():
        spark.conf.set(k, v)


def _write(path, files):
    os.makedirs(path, exist_ok=True)
    for name, text in files.items():
        with open(f"{path}/{name}", "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return path


def _cell(rng):
    return rng.choice(["", "x", "two words", 'say "hi"', "a,b", "line\nbreak", "\n", 'end"', '"', "é\r\nü", "1.50", "it's"])


def _spelled(rng, cell):
    if any(c in cell for c in ',"\n\r') or rng.random() < 0.2:
        return '"' + cell.replace('"', '""') + '"'
    return cell


def _csv_file(rng, n):
    width = rng.randint(1, 4)
    rows = [[f"h{i}\nx" if rng.random() < 0.2 else f"h{i}" for i in range(width)]]
    rows += [[_cell(rng) for _ in range(rng.choice([width, width, width, width + 1, 1]))] for _ in range(n)]
    return "".join(",".join(_spelled(rng, c) for c in r) + rng.choice(["\n", "\n", "\r\n"]) for r in rows)


def test_csv_equals_pythons_reader(spark, tmpdir_path, split):
    rng = random.Random(split)
    files = {f"f{k}.csv": _csv_file(rng, 40) for k in range(4)}
    files["open.csv"] = 'a,b\n1,"never\nclosed, to\nthe end'
    files["blank.csv"] = "\n\na,b\n\n1,2\n\r\n3,4"
    files["mid.csv"] = 'a,b\n5" pipe,6" pipe\nx"y,"z\nz"\n'
    land = land_csv(spark, _write(f"{tmpdir_path}/in", files), "r", "t", "b1", "2024-01-01T00:00:00")
    landed, rejected = [], 0
    for text in files.values():
        rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r and r != [""] or r == [""] and '""' in text]
        names = rows[0]
        for n, r in enumerate(x for x in rows[1:]):
            if any(c != "" for c in r[len(names):]):
                rejected += 1
            else:
                landed.append((n, {k: r[i] if i < len(r) else "" for i, k in enumerate(names)}))
    got = [(json.loads(r.metadata)["row_number"], json.loads(r.payload)) for r in land.bronze.collect()]
    key = lambda x: (x[0], json.dumps(x[1], sort_keys=True))
    assert sorted(got, key=key) == sorted(landed, key=key)
    run = land.run.first()
    assert (run.records_in, run.records_rejected) == (len(landed) + rejected, rejected) and land.rejects.count() == rejected


def test_csv_header_over_lines_keeps_all_columns(spark, tmpdir_path):
    d = _write(f"{tmpdir_path}/in", {"a.csv": '"a\nx",b,c\n1,2,3\n4,5,6\n'})
    land = land_csv(spark, d, "r", "t", "b1", "2024-01-01T00:00:00")
    assert sorted(r.payload for r in land.bronze.collect()) == ['{"a\\nx":"1","b":"2","c":"3"}', '{"a\\nx":"4","b":"5","c":"6"}']


def _value(rng, depth=0):
    if depth < 3 and rng.random() < 0.5:
        if rng.random() < 0.5:
            return {rng.choice(["a", "b,c", 'q"', "[", "}"]) + str(i): _value(rng, depth + 1) for i in range(rng.randint(0, 3))}
        return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, True, None, "plain", "a,b", '[{"', "back\\slash", "\\", 'end\\"', "é\n", ",", "]}"])


def test_json_documents_of_many_blocks(spark, tmpdir_path, split):
    rng = random.Random(split + 1)
    files, want, bad = {}, [], 0
    for k in range(4):
        doc = [_value(rng) for _ in range(30)]
        files[f"array{k}.json"] = json.dumps(doc, indent=[None, 1, 0, 2][k], ensure_ascii=False)
        want += doc
    for k in range(2):
        doc = {f"k{i}": _value(rng) for i in range(20)}
        files[f"object{k}.json"] = json.dumps(doc, indent=[2, None][k])
        want.append(doc)
    files |= {"empty_array.json": "[ \n ]", "none.json": "", "blank.json": " \n \n"}
    lines = [{"n": i, "t": "x,y"} for i in range(50)]
    files["bad_first.json"] = "not json\n" + "\n".join(json.dumps(x) for x in lines)
    files["bad_brace.json"] = "{bad\n" + "\n".join(json.dumps(x) for x in lines)
    files["bad_bracket.json"] = "[1, 2\n" + "\n".join(json.dumps(x) for x in lines)
    files["arrays_by_line.json"] = "[1]\n[2, 3]\n"
    files["trailing_comma.json"] = '[{"a": 1},\n]\n'
    files["two_documents.json"] = "[1\n]\n[2\n]\n"
    want += lines * 3 + [[1], [2, 3]]
    bad += 3 + 2 + 4
    land = land_json(spark, _write(f"{tmpdir_path}/in", files), "items", "t", "b1", "2024-01-01T00:00:00")
    got = [json.loads(r.payload) for r in land.bronze.collect()]
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert land.run.first().records_rejected == bad == land.rejects.count()


def test_json_array_rows_come_from_many_tasks(spark, tmpdir_path):
    d = _write(f"{tmpdir_path}/in", {"a.json": "[" + ",".join('{"a":%d,"b":"x"}' % i for i in range(3000)) + "]"})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        land = land_json(spark, d, "items", "t", "b1", "2024-01-01T00:00:00")
        rows = land.bronze.collect()
        assert sorted(json.loads(r.payload)["a"] for r in rows) == list(range(3000))
        assert [json.loads(r.payload)["a"] for r in sorted(rows, key=lambda r: r.id)] == list(range(3000))       # ids in file order
        from pyspark.sql import functions as F

        units = spark.read.option("lineSep", ",").text(d)
        assert units.select(F.spark_partition_id()).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_rows_are_parsed_once(spark, tmpdir_path):
    """Whatever is read of a landing, its files are not read and parsed again."""
    d = _write(f"{tmpdir_path}/in", {"a.csv": 'a,b\n1,"x\ny"\n2,z,beyond\n', "b.csv": "b\n\n7\n"})
    land = land_csv(spark, d, "r", "t", "b1", "2024-01-01T00:00:00")
    assert not [f for df in (land.bronze, land.rejects, land.run) for f in df.inputFiles() if f.endswith(".csv")]
    assert sorted(r.payload for r in land.bronze.collect()) == ['{"a":"1","b":"x\\ny"}', '{"b":"7"}']
    assert [(r.row_number, r.raw) for r in land.rejects.collect()] == [(1, "2,z,beyond")]


@pytest.mark.parametrize("size", [256, 1 << 20])
def test_json_long_lines_are_read_in_pieces(spark, tmpdir_path, monkeypatch, size):
    """Files whose lines are too long to be one value: documents come from
    their pieces, other files by lines; nothing is read of them again."""
    monkeypatch.setattr("tierline.sources.landing.LONG_LINE", 200)
    doc = [{"n": i, "t": ["a, b", "]},{", 'q"']} for i in range(40)]
    lines = [{"n": 100 + i, "t": "x" * (300 if i == 7 else i)} for i in range(20)]
    files = {"one.json": json.dumps(doc), "two.json": json.dumps({"k": doc}), "many.json": "\n".join(map(json.dumps, lines)),
             "short.json": '{"n": 1}\r\n{"n": 2}\r\n', "broken.json": json.dumps(doc)[:-1] + "\n[5]", "blank.json": " " * 500}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        land = land_json(spark, _write(f"{tmpdir_path}/in", files), "items", "t", "b1", "2024-01-01T00:00:00")
        rows = land.bronze.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    key = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(key(json.loads(r.payload)) for r in rows) == sorted(map(key, [*doc, {"k": doc}, *lines, {"n": 1}, {"n": 2}, [5]]))
    assert [r.raw for r in land.rejects.collect()] == [json.dumps(doc)[:-1]]
    assert not [f for df in (land.bronze, land.rejects, land.run) for f in df.inputFiles() if f.endswith(".json")]
