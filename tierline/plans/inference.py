"""Inference plans (P1-P7): field frames of whole bronze tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.operators.infer import infer_fields
from tierline.plans.common import BATCH, INGESTED_AT, TENANT, dealt, table
from tierline.plans.core import bronze_orders
from tierline.sources.landing import envelope


def customer_records(spark, sf_dir):
    """Contacts-like records derived from ``customer``: PII names, optional
    fields, text numbers, dates, URLs, a list and an object."""
    c = dealt(table(spark, sf_dir, "customer"))
    k = F.col("c_custkey")
    return c.select(
        k.alias("customer_id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1 555 "), F.lpad(k.cast("string"), 7, "0")).alias("phone"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_nationkey").alias("nation_key"),
        F.when(F.col("c_acctbal") < 0, F.lit("negative balance")).alias("notes"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 365).cast("int")),
                      "yyyy-MM-dd").alias("signup"),
        F.lpad((k % 100000).cast("string"), 5, "0").alias("zip"),
        F.concat(F.lit("https://shop.example.com/c/"), k.cast("string")).alias("website"),
        F.array(F.col("c_mktsegment")).alias("tags"),
        F.struct(F.col("c_nationkey").alias("nation")).alias("address"),
        F.lpad(k.cast("string"), 6, "0").alias("account_code"),
        k.alias("_pos"),
    )


def bronze_customers(spark, sf_dir):
    """Customer records landed as envelopes; the record position is the
    customer key, read back from the payload (no join to the source)."""
    b = envelope(customer_records(spark, sf_dir), "customers", TENANT, BATCH, INGESTED_AT, position="_pos")
    return b.withColumn("_pos", F.get_json_object("payload", "$.customer_id").cast("long"))


def _out(fields):
    return fields.select("name", "ordinal", "data_type", "nullable", "is_pii", "is_pk",
                         "n_present", F.array_join("samples", "|").alias("samples"))


def q_infer_fields_customers(spark, sf_dir):
    return _out(infer_fields(bronze_customers(spark, sf_dir), "_pos", entity_name="customers"))


def _first3(expr, order="c_custkey", where="TRUE"):
    return (f"(SELECT string_agg(v, '|' ORDER BY o) FROM (SELECT {expr} AS v, {order} AS o "
            f"FROM customer WHERE ({expr}) IS NOT NULL AND {where} ORDER BY {order} LIMIT 3))")


SQL_INFER_CUSTOMERS = f"""
WITH t AS (SELECT COUNT(*) AS n, COUNT_IF(c_acctbal < 0) AS neg FROM customer)
SELECT * FROM (VALUES
 ('customer_id', 0, 'int', false, false, true, (SELECT n FROM t), {_first3("CAST(c_custkey AS VARCHAR)")}),
 ('full_name', 1, 'string', false, true, false, (SELECT n FROM t), ''),
 ('email', 2, 'string', false, true, false, (SELECT n FROM t), ''),
 ('phone', 3, 'string', false, true, false, (SELECT n FROM t), ''),
 ('segment', 4, 'string', false, false, false, (SELECT n FROM t), {_first3("c_mktsegment")}),
 ('balance', 5, 'float', false, false, false, (SELECT n FROM t), {_first3("CAST(c_acctbal AS VARCHAR)")}),
 ('nation_key', 6, 'int', false, false, false, (SELECT n FROM t), {_first3("CAST(c_nationkey AS VARCHAR)")}),
 ('notes', 7, 'string', (SELECT neg FROM t) < (SELECT n FROM t), false, false, (SELECT neg FROM t),
  COALESCE({_first3("'negative balance'", where="c_acctbal < 0")}, '')),
 ('signup', 8, 'timestamp', false, false, false, (SELECT n FROM t),
  {_first3("strftime(DATE '2020-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d')")}),
 ('zip', 9, 'int', false, true, false, (SELECT n FROM t), ''),
 ('website', 10, 'string', false, false, false, (SELECT n FROM t),
  {_first3("'https://shop.example.com/c/' || CAST(c_custkey AS VARCHAR)")}),
 ('tags', 11, 'array', false, false, false, (SELECT n FROM t), {_first3("'[\"' || c_mktsegment || '\"]'")}),
 ('address', 12, 'json', false, true, false, (SELECT n FROM t), ''),
 ('account_code', 13, 'string', false, false, false, (SELECT n FROM t),
  {_first3("lpad(CAST(c_custkey AS VARCHAR), 6, '0')")})
) AS v(name, ordinal, data_type, nullable, is_pii, is_pk, n_present, samples)
"""


def q_infer_fields_orders(spark, sf_dir):
    return inferred_orders(bronze_orders(spark, sf_dir))


def inferred_orders(bronze):
    b = bronze.withColumn("_pos", F.get_json_object("payload", "$.order_id").cast("long"))
    return _out(infer_fields(b, "_pos", entity_name="orders"))


SQL_INFER_ORDERS = f"""
WITH t AS (SELECT COUNT(*) AS n,
                  COUNT(c.c_mktsegment) AS seg
           FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
f AS (SELECT o.*, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)
SELECT * FROM (VALUES
 ('order_id', 0, 'string', false, false, true, (SELECT n FROM t),
  (SELECT string_agg(v, '|' ORDER BY o) FROM (SELECT CAST(o_orderkey AS VARCHAR) v, o_orderkey o
   FROM f ORDER BY o_orderkey LIMIT 3))),
 ('customer_id', 1, 'string', false, false, false, (SELECT n FROM t),
  (SELECT string_agg(v, '|' ORDER BY o) FROM (SELECT 'cust-' || CAST(o_custkey AS VARCHAR) v, o_orderkey o
   FROM f ORDER BY o_orderkey LIMIT 3))),
 ('status', 2, 'string', false, false, false, (SELECT n FROM t),
  (SELECT string_agg(v, '|' ORDER BY o) FROM (SELECT o_orderstatus v, o_orderkey o
   FROM f ORDER BY o_orderkey LIMIT 3))),
 ('created_at', 3, 'timestamp', false, false, false, (SELECT n FROM t),
  (SELECT string_agg(v, '|' ORDER BY o) FROM (SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') v,
   o_orderkey o FROM f ORDER BY o_orderkey LIMIT 3))),
 ('shipping_country', 4, 'string', (SELECT seg FROM t) < (SELECT n FROM t), false, false, (SELECT seg FROM t),
  (SELECT string_agg(v, '|' ORDER BY o) FROM (SELECT c_mktsegment v, o_orderkey o
   FROM f WHERE c_mktsegment IS NOT NULL ORDER BY o_orderkey LIMIT 3))),
 ('total', 5, 'float', false, false, false, (SELECT n FROM t),
  (SELECT string_agg(v, '|' ORDER BY o) FROM (SELECT CAST(o_totalprice AS VARCHAR) v, o_orderkey o
   FROM f ORDER BY o_orderkey LIMIT 3)))
) AS v(name, ordinal, data_type, nullable, is_pii, is_pk, n_present, samples)
"""

QUERIES = {
    "infer_fields_customers": (q_infer_fields_customers, SQL_INFER_CUSTOMERS),
    "infer_fields_orders": (q_infer_fields_orders, SQL_INFER_ORDERS),
}
