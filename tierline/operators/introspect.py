"""Catalogue introspection.

Key discovery runs over the whole bronze table as grouped aggregates
(first-seen order from the record position), instead of looking at one
sample payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierline.operators.query import number_rows

# Fixed column signatures of the storage kinds.
WEBHOOK_SIGNATURE = ["id", "tenant_id", "ingested_at", "source", "payload", "metadata"]
CSV_SIGNATURE = ["_id", "_tenant_id", "_ingested_at"]


def _record_keys(bronze: DataFrame, position: str, payload: str) -> DataFrame:
    v = F.try_parse_json(payload)
    kind = F.schema_of_variant(v)
    # an array payload: keys of its first element
    first = F.when(kind.startswith("ARRAY"), F.get_json_object(F.col(payload), "$[0]")).otherwise(F.col(payload))
    return bronze.select(F.col(position).alias("rec"), F.col(payload).alias("_p"),
                         kind.startswith("ARRAY").alias("from_array"), first.alias("_obj"))


def payload_keys(bronze: DataFrame, position: str, payload: str = "payload") -> DataFrame:
    """P8 every payload key with its first-seen ordinal and record count; an
    array payload contributes the keys of its first element."""
    r = _record_keys(bronze, position, payload)
    k = r.select("rec", "from_array", F.posexplode(F.json_object_keys("_obj")).alias("pos", "key"))
    g = k.groupBy("key").agg(F.min("rec").alias("_rec"), F.min_by("pos", "rec").alias("_pos"),
                             F.count(F.lit(1)).alias("n_records"),
                             F.bool_or("from_array").alias("from_array"))
    # payloads may use ids as keys: any number of them
    return number_rows(g, ["_rec", "_pos", "key"], "ordinal").select("key", F.col("ordinal").cast("int").alias("ordinal"), "n_records", "from_array")


def array_subkeys(bronze: DataFrame, position: str, payload: str = "payload") -> DataFrame:
    """P9 for object payloads: keys whose value is an array starting with an
    object, and the sub-keys of that first element (text order)."""
    r = _record_keys(bronze, position, payload).filter(~F.col("from_array"))
    # values as JSON text per key (nested values stay text), first element of arrays
    vals = r.select("rec", F.explode(F.from_json("_obj", "map<string,string>")).alias("key", "_val"))
    k = vals.filter(F.ltrim("_val").startswith("[")) \
        .select("rec", "key", F.get_json_object("_val", "$[0]").alias("_e")) \
        .filter(F.ltrim("_e").startswith("{"))
    s = k.select("rec", "key", F.posexplode(F.json_object_keys("_e")).alias("pos", "subkey"))
    g = s.groupBy("key", "subkey").agg(F.min("rec").alias("_rec"), F.min_by("pos", "rec").alias("_pos"),
                                       F.count(F.lit(1)).alias("n_records"))
    w = Window.partitionBy("key").orderBy("_rec", "_pos")
    return g.select("key", "subkey", (F.row_number().over(w) - 1).alias("ordinal"), "n_records")


def columns_frame(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """S18 (table, ordinal, name, type) of every column, schema order.  Built
    from schemas (metadata), not from data."""
    rows = [(t, i, f.name, f.dataType.simpleString())
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, name string, type string")


def storage_class(columns: DataFrame) -> DataFrame:
    """P10 per table: ``webhook`` (all six envelope columns), ``csv`` (the
    three underscore columns and no payload) or ``flat``."""
    g = columns.groupBy("table_name").agg(F.collect_set("name").alias("_cols"))
    web = F.size(F.array_except(F.array(*[F.lit(c) for c in WEBHOOK_SIGNATURE]), F.col("_cols"))) == 0
    csv = (F.size(F.array_except(F.array(*[F.lit(c) for c in CSV_SIGNATURE]), F.col("_cols"))) == 0) \
        & ~F.array_contains("_cols", "payload")
    return g.select("table_name", F.when(web, "webhook").when(csv, "csv").otherwise("flat").alias("storage"))


def visible_tables(entities: DataFrame, layers: list[str]) -> DataFrame:
    """S17 tables a role may see (its layers), with their layer."""
    return entities.filter(F.col("layer").isin(layers)).select("tenant_id", "name", "layer")
