"""Catalogue plans: key discovery (P8, P9), storage class (P10, S18),
entity field nesting (J8), collection snapshot export / import (S19, S20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators import catalog as K
from tierline.operators import introspect as I
from tierline.plans import control
from tierline.plans.common import table
from tierline.plans.core import bronze_orders, orders_cleaned, orders_with_items


def _nested_bronze(spark, sf_dir):
    b = orders_with_items(spark, sf_dir)
    return b.withColumn("_pos", F.get_json_object("payload", "$.order_id").cast("long"))


def q_payload_keys(spark, sf_dir):
    return I.payload_keys(_nested_bronze(spark, sf_dir), "_pos")


SQL_PAYLOAD_KEYS = """
SELECT * FROM (VALUES ('order_id', 0), ('created_at', 1), ('total', 2), ('line_items', 3)) AS v(key, ordinal),
       (SELECT COUNT(*) AS n_records, false AS from_array FROM orders)
"""


def q_array_subkeys(spark, sf_dir):
    return I.array_subkeys(_nested_bronze(spark, sf_dir), "_pos")


SQL_ARRAY_SUBKEYS = """
SELECT 'line_items' AS key, subkey, ordinal,
       (SELECT COUNT(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
         AS n_records
FROM (VALUES ('l_linenumber', 0), ('l_partkey', 1), ('l_suppkey', 2), ('l_quantity', 3), ('l_extendedprice', 4),
             ('l_discount', 5), ('l_shipdate', 6)) AS v(subkey, ordinal)
"""


def q_storage_class(spark, sf_dir):
    """S18 + P10 storage kind per table from its schema, with its row count."""
    bronze = bronze_orders(spark, sf_dir)
    csv_like = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("_id"), F.lit("t0").alias("_tenant_id"),
        F.lit("2024-02-01").alias("_ingested_at"), F.col("c_name").cast("string"))
    tables = {"bronze.orders": bronze, "bronze.customers_csv": csv_like,
              "silver.orders_cleaned": orders_cleaned(bronze)}
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
                                            for t, df in tables.items()])
    return I.storage_class(I.columns_frame(spark, tables)).join(counts, "table_name")


SQL_STORAGE_CLASS = """
SELECT 'bronze.orders' AS table_name, 'webhook' AS storage, COUNT(*) AS n_rows FROM orders
UNION ALL SELECT 'bronze.customers_csv', 'csv', COUNT(*) FROM customer
UNION ALL SELECT 'silver.orders_cleaned', 'flat', COUNT(*) FROM orders
"""


def _entity_bronzes(spark, sf_dir):
    """Bronze payloads of three entities in one frame (entity column)."""
    from tierline.plans.inference import customer_records
    from tierline.sources.landing import envelope
    o = bronze_orders(spark, sf_dir).select(F.lit("orders").alias("entity"), "payload",
                                            F.get_json_object("payload", "$.order_id").cast("long").alias("_pos"))
    c = envelope(customer_records(spark, sf_dir), "customers", "t0", "b1", "2024-02-01T00:00:00",
                 position="_pos").select(F.lit("customers").alias("entity"), "payload",
                                         F.get_json_object("payload", "$.customer_id").cast("long").alias("_pos"))
    e = table(spark, sf_dir, "events")
    ev = e.select(F.lit("events").alias("entity"), F.to_json(F.struct(*[F.col(x) for x in e.columns]))
                  .alias("payload"), F.col("event_id").alias("_pos"))
    return o.unionByName(c).unionByName(ev)


def q_pk_guess(spark, sf_dir):
    """P6 the key guessed for each entity from its inferred fields."""
    from tierline.operators.infer import infer_fields
    f = infer_fields(_entity_bronzes(spark, sf_dir), "_pos", entity="entity")
    return f.filter("is_pk").select("entity", F.col("name").alias("pk"))


SQL_PK_GUESS = """
SELECT * FROM (VALUES ('orders', 'order_id'), ('customers', 'customer_id'), ('events', 'event_id'))
  AS v(entity, pk)
"""


def q_pii_columns(spark, sf_dir):
    """P5 PII columns of each entity (by name), with their inferred type."""
    from tierline.operators.infer import infer_fields
    f = infer_fields(_entity_bronzes(spark, sf_dir), "_pos", entity="entity")
    return f.filter("is_pii").select("entity", "name", "data_type")


SQL_PII_COLUMNS = """
SELECT * FROM (VALUES ('customers', 'full_name', 'string'), ('customers', 'email', 'string'),
                      ('customers', 'phone', 'string'), ('customers', 'zip', 'int'),
                      ('customers', 'address', 'json')) AS v(entity, name, data_type)
"""


# ------------------------------------------------------------------ J8


def entity_fields(spark, sf_dir):
    """One field per word of the part type (ordinal = word position)."""
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("entity_id"),
                 F.posexplode(F.split("p_type", " ")).alias("ordinal", "word"))
    dt = F.element_at(F.array(F.lit("string"), F.lit("int"), F.lit("float")),
                      (F.length("word") % 3).cast("int") + 1)
    return f.select("entity_id", "ordinal", F.lower("word").alias("name"), dt.alias("data_type"))


def q_entity_fields_nested(spark, sf_dir):
    ents = control.catalogue_entities(spark, sf_dir)
    return K.nest_fields(ents, entity_fields(spark, sf_dir), layer="silver").select("id", "name", "layer", "fields")


_FIELDS_SQL = """
WITH w AS (SELECT p_partkey AS entity_id, i - 1 AS ordinal, string_split(p_type, ' ')[i] AS word
           FROM part, generate_series(1, len(string_split(p_type, ' '))) t(i)),
f AS (SELECT entity_id,
             to_json(list({'ordinal': ordinal, 'name': lower(word),
                           'data_type': ['string', 'int', 'float'][(length(word) % 3) + 1]} ORDER BY ordinal))::VARCHAR
               AS fields
      FROM w GROUP BY entity_id)
"""
SQL_ENTITY_FIELDS = _FIELDS_SQL + """
SELECT p_partkey AS id, 'part_' || p_partkey AS name, 'silver' AS layer, f.fields
FROM part JOIN f ON f.entity_id = p_partkey WHERE p_size % 3 = 1
"""

# ------------------------------------------------------------- S19 / S20


def _snapshot(spark, sf_dir):
    ents = K.nest_fields(control.catalogue_entities(spark, sf_dir), entity_fields(spark, sf_dir))
    t = control.transforms(spark, sf_dir)
    t = t.select("id", "name", "collection", F.lit("silver").alias("source_layer"), "target_layer",
                 F.concat(F.lit("INSERT INTO "), F.col("target_layer"), F.lit("_"), F.col("tenant_id"),
                          F.lit("."), F.col("name"), F.lit(" SELECT * FROM silver_"), F.col("tenant_id"),
                          F.lit(".src_"), F.col("id").cast("string")).alias("transform_sql"),
                 F.lit("on_change").alias("trigger_mode"))
    c = control.connectors(spark, sf_dir)
    c = c.select("id", "name", "collection", "connector_type",
                 F.create_map(F.lit("url"), F.concat(F.lit("https://api.example.com/"), F.col("name")),
                              F.lit("api_key"), F.col("name")).alias("config"),
                 (F.col("id") + 1).alias("target_entity_id"))
    return K.snapshot_items(ents, t, c)


def q_snapshot_export(spark, sf_dir):
    s = _snapshot(spark, sf_dir)
    detail = F.when(F.col("kind") == "transform", F.get_json_object("item", "$.transform_sql")) \
        .when(F.col("kind") == "connector", F.concat_ws("|", F.get_json_object("item", "$.config.api_key"),
                                                        F.get_json_object("item", "$.entity_name"))) \
        .otherwise(F.get_json_object("item", "$.fields"))
    return s.select("collection", "kind", "name", detail.alias("detail"))


SQL_SNAPSHOT_EXPORT = _FIELDS_SQL + """
SELECT p_brand AS collection, 'entity' AS kind, 'part_' || p_partkey AS name, f.fields AS detail
FROM part JOIN f ON f.entity_id = p_partkey
UNION ALL
SELECT DISTINCT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR), 'transform', 'tf_' || user_id,
       'INSERT INTO ' || ['silver', 'gold', 'silver'][(user_id % 3) + 1] || '.tf_' || user_id
       || ' SELECT * FROM silver.src_' || user_id
FROM events WHERE user_id % 2 = 1
UNION ALL
SELECT DISTINCT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR), 'connector', 'conn_' || user_id,
       '***' || CASE WHEN user_id + 1 IN (SELECT p_partkey FROM part) THEN '|part_' || (user_id + 1) ELSE '' END
FROM events WHERE user_id % 2 = 0
"""


def q_snapshot_import(spark, sf_dir):
    """S20 import every exported item into a tenant that already holds the
    items of even-numbered brands; ``overwrite`` off."""
    s = _snapshot(spark, sf_dir)
    brand_no = F.regexp_extract("collection", r"(\d+)$", 1).cast("int")
    existing = s.filter(brand_no % 2 == 0).select("kind", "name")
    out = K.import_items(s, existing, overwrite=False)
    return out.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


SQL_SNAPSHOT_IMPORT = """
WITH i AS (
  SELECT 'entity' AS kind, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS b FROM part
  UNION ALL SELECT DISTINCT 'transform' || user_id, user_id % 25 + 1 FROM events WHERE user_id % 2 = 1
  UNION ALL SELECT DISTINCT 'connector' || user_id, user_id % 25 + 1 FROM events WHERE user_id % 2 = 0)
SELECT regexp_extract(kind, '^[a-z]+', 0) AS kind, CASE WHEN b % 2 = 0 THEN 'skipped' ELSE 'created' END AS outcome,
       COUNT(*) AS n
FROM i GROUP BY ALL
"""


def q_snapshot_import_merged(spark, sf_dir):
    """S20 the items a tenant holds after an import, with and without
    ``overwrite``; it held the even-numbered brands' items in an older form."""
    s = _snapshot(spark, sf_dir)
    brand_no = F.regexp_extract("collection", r"(\d+)$", 1).cast("int")
    held = s.filter(brand_no % 2 == 0).withColumn("item", F.lit("old"))
    outs = [K.import_merge(s, held, overwrite).withColumn("overwrite", F.lit(overwrite)) for overwrite in (False, True)]
    return (outs[0].unionByName(outs[1]).groupBy("overwrite", "kind", (F.col("item") == "old").alias("old"))
            .agg(F.count(F.lit(1)).alias("n")))


SQL_SNAPSHOT_IMPORT_MERGED = """
WITH i AS (
  SELECT 'entity' AS kind, p_name AS name, p_brand AS c, CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS b FROM part
  UNION ALL SELECT DISTINCT 'transform', CAST(user_id AS VARCHAR), '', user_id % 25 + 1 FROM events WHERE user_id % 2 = 1
  UNION ALL SELECT DISTINCT 'connector', CAST(user_id AS VARCHAR), '', user_id % 25 + 1 FROM events WHERE user_id % 2 = 0),
o AS (SELECT unnest([true, false]) AS overwrite)
SELECT overwrite, kind, b % 2 = 0 AND NOT overwrite AS old, COUNT(*) AS n FROM i, o GROUP BY ALL
"""

QUERIES = {
    "snapshot_import_merged": (q_snapshot_import_merged, SQL_SNAPSHOT_IMPORT_MERGED),
    "pk_guess": (q_pk_guess, SQL_PK_GUESS),
    "pii_columns": (q_pii_columns, SQL_PII_COLUMNS),
    "payload_keys": (q_payload_keys, SQL_PAYLOAD_KEYS),
    "array_subkeys": (q_array_subkeys, SQL_ARRAY_SUBKEYS),
    "storage_class": (q_storage_class, SQL_STORAGE_CLASS),
    "entity_fields_nested": (q_entity_fields_nested, SQL_ENTITY_FIELDS),
    "snapshot_export": (q_snapshot_export, SQL_SNAPSHOT_EXPORT),
    "snapshot_import": (q_snapshot_import, SQL_SNAPSHOT_IMPORT),
}
