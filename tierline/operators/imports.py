"""One-call import (W11): records become a bronze table, registered bronze and
silver entities with fields, and a draft transform that would flatten them.

Bronze rows are appended to the entity's layer table.  ``entities``, ``fields``
and ``transforms`` are keyed control tables below ``root``: importing again
changes the rows that are there (an entity's count, its fields) and adds no
second ones; a transform that is no draft any more stays as it is.  The draft
is stored SQL in the two-statement upsert form that ``flatten.run_transform``
runs once somebody approves it; it is to run when its watched entities change.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import jsonx
from tierline.operators.flatten import TYPED, column_names, field_tuples
from tierline.operators.infer import infer_fields
from tierline.session import cut_lineage, staged
from tierline.sources import sinks
from tierline.sources.landing import Landing, envelope, land_csv, land_json, landing_run


#: Buckets of the control tables.
CONTROL_BUCKETS = 4


@dataclass
class Imported:
    """What an import did; the registered rows as they are now."""
    landing: Landing
    entity: DataFrame
    fields: DataFrame
    transform: DataFrame | None


def control_path(root: str, table: str) -> str:
    return os.path.join(root, "control", table)


def draft_sql(name: str, fields: list[tuple[str, str]], pk: str) -> str:
    """The flatten of bronze into silver as stored SQL: create when missing,
    then insert or replace by the key."""
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def cell(field: str, kind: str | None) -> str:
        if "'" in field:           # no path can name this key
            if kind in TYPED:
                held = f"try_variant_get(try_parse_json(payload), '$', 'map<string,variant>')[{text(field)}]"
                return f"try_variant_get({held}, '$', '{jsonx.PLATFORM_TYPES[kind]}')"
            return f"from_json(payload, 'map<string,string>')[{text(field)}]"
        path = text(jsonx.json_path(field))
        if kind in TYPED:
            return f"try_variant_get(try_parse_json(payload), {path}, '{jsonx.PLATFORM_TYPES[kind]}')"
        return f"get_json_object(payload, {path})"

    columns = column_names([n for n, _ in fields])
    cells = [f"{cell(*f)} AS `{c.replace('`', '``')}`" for f, c in zip(fields, columns, strict=True)]
    select = f"SELECT {', '.join(cells)} FROM bronze.{name}"
    return (f"CREATE TABLE IF NOT EXISTS silver.{name} AS {select} LIMIT 0;\n"
            f"INSERT OR REPLACE INTO silver.{name} {select} WHERE {cell(pk, None)} IS NOT NULL")


def import_file(spark: SparkSession, path: str, fmt: str, source: str, tenant: str, root: str, batch_id: str,
                ingested_at: str, **options) -> Imported:
    """Land a CSV or JSON file (``fmt``) and register it (``register``)."""
    landing = {"csv": land_csv, "json": land_json}[fmt](spark, path, source, tenant, batch_id, ingested_at)
    return register(spark, landing, source, tenant, root, ingested_at, **options)


def import_records(spark: SparkSession, records: DataFrame, source: str, tenant: str, root: str, batch_id: str,
                   ingested_at: str, payload: str = "payload", position: str | None = None, **options) -> Imported:
    """The same from records at hand: ``payload`` holds one JSON object a row
    (inline samples, webhook bodies).  Other texts are rejects."""
    rows = records.select(F.col(payload).cast("string").alias("payload"),
                          (F.monotonically_increasing_id() if position is None else F.col(position).cast("long")).alias("pos"))
    rows = staged(rows.withColumn("ok", jsonx.is_json("payload") & F.ltrim("payload").startswith("{")), "import-records")
    good = envelope(rows.filter("ok"), source, tenant, batch_id, ingested_at, position=F.col("pos"), payload=F.trim("payload"))
    bad = rows.filter("NOT coalesce(ok, false)").select(F.lit(None).cast("string").alias("file"), F.col("pos").alias("row_number"), F.col("payload").alias("raw"))
    run = landing_run(good, bad, batch_id, ingested_at, f"bronze.{_name(source)}")
    return register(spark, Landing(good, bad, run), source, tenant, root, ingested_at, **options)


def import_pages(spark: SparkSession, bronze: DataFrame, source: str, tenant: str, root: str, batch_id: str,
                 ingested_at: str, **options) -> Imported:
    """The same from a landed paged pull (``sources.pages.land_pages``)."""
    none = spark.createDataFrame([], "file string, row_number long, raw string")
    run = landing_run(bronze, none, batch_id, ingested_at, f"bronze.{_name(source)}")
    return register(spark, Landing(bronze, none, run), source, tenant, root, ingested_at, **options)


def _name(source: str) -> str:
    return re.sub(r"\W", "_", source.lower())


def _put(spark: SparkSession, root: str, table: str, rows: DataFrame, key, deleted: str | None = None) -> None:
    at = control_path(root, table)
    sinks.upsert_table(spark, at, rows, key, CONTROL_BUCKETS, deleted=deleted)


def control_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a control table."""
    return spark.read.parquet(control_path(root, table)).drop(sinks.BUCKET_COL)


def register(spark: SparkSession, landing: Landing, source: str, tenant: str, root: str, ingested_at: str,
             key: str | None = None, skip_transform: bool = False) -> Imported:
    """Append what has landed to bronze, infer fields and key over the records
    of the batch, register entity and fields, and, unless ``skip_transform`` or
    nothing landed, a silver entity with its fields and the draft transform.

    ``key`` overrides the inferred key; without either the first field serves.
    """
    name = _name(source)
    at = sinks.layer_path(root, tenant, "bronze", name)
    landed = staged(landing.bronze, "import-landed")
    sinks.append_bronze(landed, at)
    # ids of a batch sort in landing order
    position = F.conv(F.substring("id", 1, 16), 16, 10).cast("long")
    found = cut_lineage(infer_fields(landed.withColumn("_pos", position), "_pos", entity_name=name), spark)
    tuples = field_tuples(found)
    keys = [r["name"] for r in found.filter("is_pk").select("name").collect()]      # at most one
    if key is not None and key not in [n for n, _ in tuples]:
        raise ValueError(f"{name} has no field {key}")
    pk = key or (keys or [n for n, _ in tuples] or [""])[0]
    total = sinks.read_bronze(spark, at).agg(F.count(F.lit(1)).alias("n_records"))

    def entity(layer: str) -> DataFrame:
        count = total if layer == "bronze" else spark.range(1).select(F.lit(None).cast("long").alias("n_records"))
        return count.select(F.lit(f"{tenant}.{layer}.{name}").alias("id"), F.lit(tenant).alias("tenant_id"), F.lit(name).alias("name"),
                            F.lit(layer).alias("layer"), F.col("n_records").cast("long").alias("n_records"))

    columns = spark.createDataFrame(list(zip([n for n, _ in tuples], column_names([n for n, _ in tuples]), strict=True)), "name string, column string")

    def fields(layer: str) -> DataFrame:
        rows = found.join(columns, "name").withColumn("own", F.col("name") if layer == "bronze" else F.col("column"))
        return rows.select(F.lit(f"{tenant}.{layer}.{name}").alias("entity_id"), "ordinal", F.col("own").alias("name"), "data_type", "nullable",
                           "is_pii", (F.col("name") == pk).alias("is_pk"))

    drafting = bool(tuples) and not skip_transform
    layers = ["bronze", "silver"] if drafting else ["bronze"]
    for layer in layers:
        _put(spark, root, "entities", entity(layer), "id")
        rows = fields(layer).withColumn("gone", F.lit(False))
        if sinks.upsert_table_exists(spark, control_path(root, "fields")):
            old = control_table(spark, root, "fields").filter(F.col("entity_id") == f"{tenant}.{layer}.{name}")
            rows = rows.unionByName(old.join(rows.select("entity_id", "name"), ["entity_id", "name"], "left_anti").withColumn("gone", F.lit(True)))
        _put(spark, root, "fields", rows, ["entity_id", "name"], deleted="gone")
    transform = None
    if drafting:
        row = (f"t-{name}", tenant, name, "bronze", "silver", "draft", dict(zip([n for n, _ in tuples], column_names([n for n, _ in tuples]), strict=True))[pk],
               draft_sql(name, tuples, pk), "on_change", [f"{tenant}.bronze.{name}"])
        draft = spark.createDataFrame([row], "id string, tenant_id string, name string, source_layer string, target_layer string, status string, "
                                             "key string, transform_sql string, trigger_mode string, watch_entities array<string>")
        if sinks.upsert_table_exists(spark, control_path(root, "transforms")):
            done = control_table(spark, root, "transforms").filter("status <> 'draft'")
            draft = draft.join(done.select("id"), "id", "left_anti").select(*draft.columns)
        _put(spark, root, "transforms", draft, "id")
        transform = control_table(spark, root, "transforms").filter(F.col("id") == f"t-{name}")
    own = F.col("entity_id").isin([f"{tenant}.{layer}.{name}" for layer in layers])
    return Imported(landing, control_table(spark, root, "entities").filter(F.col("id") == f"{tenant}.bronze.{name}"),
                    control_table(spark, root, "fields").filter(own), transform)
