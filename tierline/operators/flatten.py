"""Bronze -> silver flatten (W10), one-call import (W11), running a stored
transform (W12) and the non-empty source check (W13)."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierline.functions import jsonx
from tierline.operators import merge
from tierline.operators.governance import run_query, tables_named
from tierline.sources import sinks

TYPED = ("int", "float", "bool", "timestamp")


def column_names(names: list[str]) -> list[str]:
    """Column of each field.  Columns are told apart without case, JSON keys
    with it: of names that differ in case only the first stays as it is, later
    ones get ``_2``, ``_3`` and so on (whatever is free)."""
    taken = {n.lower() for n in names}
    seen, out = set(), []
    for name in names:
        column, n = name, 1
        while column.lower() in seen or (n > 1 and column.lower() in taken):
            n += 1
            column = f"{name}_{n}"
        seen.add(column.lower())
        out.append(column)
    return out


def flatten_select(bronze: DataFrame, fields: list[tuple[str, str]], pk: str | None,
                   payload: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """W10 projection: typed fields via one VARIANT parse, text fields via the
    JSON text extractor (json / array stay JSON text), rows without a key
    dropped (E6).  Narrow: filter and projection only; both reach the scan's
    column pruning (only ``payload`` and ``keep`` columns are read).  Columns
    are named by ``column_names``.
    """
    keep = keep or []
    parsed = bronze.select(*keep, F.col(payload).alias("_p"), jsonx.parse(payload).alias("_v"))
    cols = []
    for (name, dtype), column in zip(fields, column_names([n for n, _ in fields]), strict=True):
        if dtype in TYPED:
            cols.append(jsonx.typed("_v", name, dtype).alias(column))
        else:
            cols.append(jsonx.text("_p", name).alias(column))
    out = parsed
    if pk:
        out = out.filter(jsonx.text("_p", pk).isNotNull())
    return out.select(*cols, *keep)


def flatten(bronze: DataFrame, fields: list[tuple[str, str]], pk: str | None,
            target: DataFrame | None = None, order_by: list | None = None) -> DataFrame:
    """W10 = W2 (empty typed target when missing) + projection + W3 upsert on
    pk.  Within the batch the newest landing wins (H3): ``order_by`` if
    given, else the envelope's (ingested_at, id), else the key alone."""
    if not pk:
        return flatten_select(bronze, fields, None)
    envelope_order = [c for c in ("ingested_at", "id") if c in bronze.columns]
    names = column_names([n for n, _ in fields])
    key = dict(zip([n for n, _ in fields], names, strict=True)).get(pk, pk)
    if order_by is None and envelope_order:
        keep = [c for c in envelope_order if c not in names]
        rows = flatten_select(bronze, fields, pk, keep=keep)
        order = envelope_order
    else:
        rows = flatten_select(bronze, fields, pk)
        order = order_by or [key]
    # keys of payloads may hold any character: the merge works on plain names
    plain, by = [f"c{i}" for i in range(len(names))], [f"o{i}" for i in range(len(order))]
    rows = rows.select(*[F.col(f"`{n.replace('`', '``')}`").alias(p) for n, p in zip(names, plain, strict=True)],
                       *[(F.col(f"`{c.replace('`', '``')}`") if isinstance(c, str) else c).alias(o) for c, o in zip(order, by, strict=True)])
    at = dict(zip(names, plain, strict=True))
    target = (rows.select(*plain).limit(0) if target is None
              else target.select(*[F.col(f"`{n.replace('`', '``')}`").alias(at[n]) for n in names]))
    out = merge.upsert(target, rows, at[key], order_by=by)
    return out.select(*plain).toDF(*names)


def field_tuples(fields_df: DataFrame) -> list[tuple[str, str]]:
    """Bounded field list (one row per key of the payload) -> python tuples,
    ordinal order.  This is schema, not data."""
    rows = fields_df.select("name", "data_type", "ordinal").orderBy("ordinal").collect()
    return [(r["name"], r["data_type"]) for r in rows]


def non_empty(df: DataFrame) -> bool:
    """W13 stops after the first row found."""
    return df.limit(1).count() > 0


@dataclass
class RunResult:
    output: DataFrame | None
    run: DataFrame


def _run_row(one: DataFrame, run_id: str, transform_id: str, status: str, started_at: str, t0: float,
             error: str | None, rows=None) -> DataFrame:
    return one.select(F.lit(run_id).alias("id"), F.lit(transform_id).alias("transform_id"), F.lit(status).alias("status"),
                      F.lit(started_at).alias("started_at"), (F.lit(0) if rows is None else rows).cast("long").alias("rows_produced"),
                      F.lit(int((time.time() - t0) * 1000)).cast("long").alias("duration_ms"),
                      F.lit(error).cast("string").alias("error_detail"))


#: The statements of a stored transform: what they do with which table, and
#: the query or the declared columns.
_STATEMENT = re.compile(
    r"(?:CREATE\s+(?P<replace>OR\s+REPLACE\s+)?(?P<temp>TEMP(?:ORARY)?\s+)?TABLE\s+(?P<missing>IF\s+NOT\s+EXISTS\s+)?(?P<table>\w+\.\w+)\s*"
    r"(?:\bAS\s+(?P<made>(?:SELECT|WITH)\b.*)|\((?P<columns>.*)\))"
    r"|INSERT\s+(?:OR\s+(?P<conflict>REPLACE|IGNORE)\s+)?INTO\s+(?P<into>\w+\.\w+)\s*(?:\((?P<names>[^()]*)\)\s*)?(?P<query>(?:SELECT|WITH)\b.*)"
    r"|(?P<read>(?:SELECT|WITH)\b.*))", re.IGNORECASE | re.DOTALL)
#: A piece of SQL text: a comment, something quoted, or one other character.
_PIECE = re.compile(r"""(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<quoted>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)|(?P<end>;)|.""",
                    re.DOTALL)
#: Names that stored SQL of other engines uses, in Spark's words.
_FUNCTIONS = {"json_extract_string": "get_json_object", "json_extract": "get_json_object"}
_TYPES = {"varchar": "string", "text": "string", "json": "string", "double": "double", "integer": "int", "timestamp": "timestamp_ntz"}
_FUNCTION = re.compile(rf"\b({'|'.join(_FUNCTIONS)})(?=\s*\()", re.IGNORECASE)
_CAST = re.compile(rf"\b(AS\s+)({'|'.join(_TYPES)})(?=\s*\))", re.IGNORECASE)


def split_statements(sql: str) -> list[str]:
    """SQL text cut at its semicolons, without comments.  Quotes and comments
    hide each other and semicolons; function and type names that Spark spells
    otherwise are replaced outside of both."""
    out, plain, parts = [], [], []

    def spoken():
        text = _FUNCTION.sub(lambda m: _FUNCTIONS[m[1].lower()], "".join(plain))
        parts.append(_CAST.sub(lambda m: m[1] + _TYPES[m[2].lower()], text))
        plain.clear()

    for m in _PIECE.finditer(sql):
        if m["comment"]:
            plain.append(" ")
        elif m["quoted"]:
            spoken()
            parts.append(m[0])
        elif m["end"]:
            spoken()
            out.append("".join(parts).strip())
            parts.clear()
        else:
            plain.append(m[0])
    spoken()
    out.append("".join(parts).strip())
    return [x for x in out if x]


def statements(sql: str) -> list[re.Match]:
    """The statements of a stored transform; anything else is an error."""
    out = []
    for part in split_statements(sql):
        m = _STATEMENT.fullmatch(part)
        if not m:
            raise ValueError(f"not a transform statement: {part}")
        out.append(m)
    if not out:
        raise ValueError("the transform has no statement")
    return out


def declared(columns: str) -> tuple[T.StructType, list[str]]:
    """Schema and primary key of a CREATE TABLE's column list."""
    fields, keys = [], []
    for part in re.findall(r"(?:`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|\([^()]*\)|[^,`\"(])+", columns):
        part = part.strip()
        own = re.fullmatch(r"(?i)PRIMARY\s+KEY\s*\(([^()]*)\)", part)
        if own:
            keys += [k.strip().strip('`"') for k in own[1].split(",")]
            continue
        m = re.fullmatch(r"(?is)(`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|\w+)\s+([a-z]\w*(?:\s*\([\d\s,]*\))?)\s*((?:PRIMARY\s+KEY|NOT\s+NULL|NULL|UNIQUE)?(?:\s+(?:PRIMARY\s+KEY|NOT\s+NULL|NULL|UNIQUE))*)", part)
        if not m:
            raise ValueError(f"not a column: {part}")
        name = m[1][1:-1].replace(m[1][0] * 2, m[1][0]) if m[1][0] in '`"' else m[1]
        kind = _TYPES.get(m[2].lower(), m[2])
        kind = "string" if re.match(r"(?i)(?:var)?char\s*\(", kind) else kind
        fields.append(T.StructField(name, T._parse_datatype_string(f"x {kind}")["x"].dataType))
        if re.search(r"(?i)PRIMARY\s+KEY", m[3]):
            keys.append(name)
    return T.StructType(fields), keys


def run_transform(spark: SparkSession, transform: dict, tables: dict[str, DataFrame], root: str, tenant: str,
                  run_id: str = "run", started_at: str = "", role: str = "owner",
                  cascade: Callable[[str], None] | None = None) -> RunResult:
    """W12 run a stored transform (``id``, ``status``, ``transform_sql``,
    optional ``key``) only when approved.

    Its statements are CREATE TABLE ``layer.name`` (IF NOT EXISTS, OR REPLACE;
    AS a query, or with declared columns), CREATE TEMP TABLE ... AS (seen by
    the statements after it, never written), INSERT (OR REPLACE, OR IGNORE)
    INTO ``layer.name`` (with or without a column list) and bare queries, which
    write nothing; some statement must name a table.  Comments may stand anywhere.  Every query is first run for
    one row (W13 of the data, G6 of the tables it names), so a bad statement
    stops the run before anything is written.  Then the statements run in
    order on the layer tables below ``root``; inserts by ``key`` (else the
    declared primary key) replace or skip rows of the same key.  The run row
    counts the written table (0 without one); with success ``cascade`` is told
    the table that changed.
    """
    t0 = time.time()
    held = dict(tables)
    keys: list[str] = [transform["key"]] if transform.get("key") else []

    def query(m: re.Match) -> DataFrame:
        return run_query(spark, m["made"] or m["query"] or m["read"], role, held)

    def path(name: str) -> str:
        return sinks.layer_path(root, tenant, *name.lower().split("."))

    def failed(error: str) -> RunResult:
        return RunResult(None, _run_row(spark.range(1), run_id, transform["id"], "failed", started_at, t0, error))

    def fitted(rows: DataFrame, m: re.Match, like: DataFrame) -> DataFrame:
        """A query's columns, by place, as the table's."""
        names = [x.strip().strip('`"') for x in m["names"].split(",")] if m["names"] else like.columns
        if len(names) != len(rows.columns):
            raise ValueError(f"{m['into']} takes {len(names)} columns, not {len(rows.columns)}")
        rows = rows.toDF(*[f"c{i}" for i in range(len(names))])
        at = {n.lower(): f"c{i}" for i, n in enumerate(names)}
        if set(at) - {c.lower() for c in like.columns}:
            raise ValueError(f"{m['into']} has no column {', '.join(sorted(set(at) - {c.lower() for c in like.columns}))}")
        return rows.select(*[(F.col(at[f.name.lower()]) if f.name.lower() in at else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in like.schema])

    if transform.get("status") != "approved":
        return failed("transform is not approved")
    target = read = None
    try:
        parts = statements(transform["transform_sql"])
        if all(m["read"] and not tables_named(spark, m["read"]) for m in parts):
            raise ValueError("the transform names no table")
        for m in parts:
            name = (m["table"] or m["into"] or "").lower()
            if m["columns"]:
                schema, own = declared(m["columns"])
                held.setdefault(name, spark.createDataFrame([], schema))
                keys = keys or own
                continue
            out = query(m).limit(1)
            non_empty(out)
            if name and name not in held:   # a later statement may read what this one makes
                held[name] = spark.createDataFrame([], out.schema)
        held = dict(tables)
        for m in parts:
            if m["read"]:
                read = query(m)
                continue
            name = (m["table"] or m["into"]).lower()
            if m["temp"]:
                held[name] = query(m) if m["made"] else spark.createDataFrame([], declared(m["columns"])[0])
                continue
            target, at = name, path(name)
            there = sinks.table_exists(spark, at)
            if m["table"]:
                if there and not m["replace"] and not m["missing"]:
                    raise ValueError(f"{target} exists")
                if m["columns"]:
                    rows = spark.createDataFrame([], declared(m["columns"])[0])
                else:
                    rows = query(m)
                if there and m["missing"]:
                    rows = None
            else:
                if not there:
                    raise ValueError(f"{target} does not exist")
                old = sinks.read_table(spark, at)
                rows = fitted(query(m), m, old)
                if not m["conflict"]:
                    rows = old.unionByName(rows)
                else:
                    if not keys:
                        raise ValueError(f"{target} has no key")
                    # columns may be named like anything: merge by place
                    plain = [f"c{i}" for i in range(len(old.columns))]
                    own = [plain[[c.lower() for c in old.columns].index(k.lower())] for k in keys]
                    change = merge.upsert if m["conflict"].upper() == "REPLACE" else merge.insert_ignore
                    rows = change(old.toDF(*plain), rows.toDF(*plain), own, order_by=[c for c in plain if c not in own] or own).toDF(*old.columns)
            if rows is not None:
                sinks.replace_table(spark, rows, at)
            held[target] = sinks.read_table(spark, at)
    except Exception as exc:  # noqa: BLE001 - the run row carries the error
        return failed(str(exc))
    if target is None:
        return RunResult(read, _run_row(spark.range(1), run_id, transform["id"], "success", started_at, t0, None))
    out = held[target]
    run = _run_row(out.agg(F.count(F.lit(1)).alias("n")), run_id, transform["id"], "success", started_at, t0, None, F.col("n"))
    if cascade:
        cascade(target)
    return RunResult(out, run)
