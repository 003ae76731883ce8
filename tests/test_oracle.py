"""Every registered query against its DuckDB oracle on the sf0.001 tables,
plus the flagship entry point."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = os.environ.get("TIERLINE_TEST_SF", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _kind_spark(t):
    t = t.lower()
    if t == "string":
        return "text"
    if t in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    if t in ("double", "float") or t.startswith("decimal"):
        return "float"
    return t


def _kind_duck(t):
    t = t.lower()
    if "varchar" in t:
        return "text"
    if t in ("bigint", "integer", "smallint", "tinyint", "hugeint", "ubigint", "uinteger"):
        return "int"
    if t in ("double", "float") or t.startswith("decimal"):
        return "float"
    return t


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["date", "country", "order_count", "total_revenue"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no oracle")
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    otypes = {d[0]: str(d[1]) for d in cur.description}
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    for f in df.schema.fields:                      # same kind of value per column
        assert _kind_spark(f.dataType.simpleString()) == _kind_duck(otypes[f.name]), (f.name, otypes[f.name])
    assert len(rows) == len(orows)
    h1, l1 = _digest(df.columns, rows)
    h2, l2 = _digest(ocols, orows)
    assert h1 == h2, (sorted(set(l1) - set(l2))[:3], sorted(set(l2) - set(l1))[:3])
