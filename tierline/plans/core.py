"""Flagship chain and the core medallion plans.

orders (+ customer) -> bronze envelope (S1) -> silver ``orders_cleaned``
(E1/E2/E5, W1) -> gold daily revenue (A1); flatten (W10), unnest (J6),
re-nest (A6), typed props (E1/E2), upsert (W3), insert-ignore (W4/N1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import jsonx
from tierline.operators import flatten as fl
from tierline.operators import merge
from tierline.plans.common import BATCH, INGESTED_AT, TENANT, r2, table, ts_text
from tierline.sources.landing import envelope


def bronze_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as webhook records: one envelope row per order."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rec = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("c_mktsegment").alias("shipping_country"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderkey").alias("_pos"),
    )
    return envelope(rec, "orders", TENANT, BATCH, INGESTED_AT,
                    metadata={"pulled_from": "orders"}, position="_pos")


def orders_cleaned(bronze: DataFrame) -> DataFrame:
    """Silver: parse in one projection, then keep rows with id and amount
    (E7: parse-then-filter)."""
    parsed = bronze.select(F.col("payload").alias("_p"), jsonx.parse("payload").alias("_v"))
    rows = parsed.select(
        jsonx.text("_p", "order_id").alias("order_id"),
        jsonx.text("_p", "customer_id").alias("customer_id"),
        jsonx.text("_p", "status").alias("status"),
        jsonx.tolerant_timestamp(jsonx.text("_p", "created_at")).alias("created_at"),
        jsonx.default_if_empty(jsonx.text("_p", "shipping_country")).alias("shipping_country"),
        jsonx.typed("_v", "total", "float").alias("total_usd"),
    )
    return rows.filter(F.col("order_id").isNotNull() & F.col("total_usd").isNotNull())


def revenue_by_country(silver: DataFrame) -> DataFrame:
    """A1 gold: per day and country, order count and revenue."""
    return (silver.groupBy(F.to_date("created_at").alias("day"), F.col("shipping_country").alias("country"))
            .agg(F.count(F.lit(1)).alias("order_count"), F.sum("total_usd").alias("total_revenue")))


def q_revenue_by_day_segment(spark, sf_dir):
    g = revenue_by_country(orders_cleaned(bronze_orders(spark, sf_dir)))
    return g.select(F.col("day").cast("string").alias("date"), "country", "order_count",
                    r2("total_revenue").alias("total_revenue"))


SQL_REVENUE = """
SELECT CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS date,
       COALESCE(NULLIF(c.c_mktsegment, ''), 'UNKNOWN') AS country,
       COUNT(*) AS order_count,
       ROUND(SUM(o.o_totalprice), 2) AS total_revenue
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderkey IS NOT NULL AND o.o_totalprice IS NOT NULL
GROUP BY 1, 2
"""

# ---------------------------------------------------------------- W10 flatten
ORDER_FIELDS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"),
                ("o_totalprice", "float"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")]


def bronze_table(spark, sf_dir, name, pos_col):
    t = table(spark, sf_dir, name)
    return envelope(t, name, TENANT, BATCH, INGESTED_AT, metadata={"format": "parquet"},
                    position=t[pos_col] if isinstance(pos_col, str) else pos_col)


def q_flatten_orders(spark, sf_dir):
    return flattened_orders(bronze_table(spark, sf_dir, "orders", "o_orderkey"))


def flattened_orders(bronze: DataFrame) -> DataFrame:
    s = fl.flatten(bronze, ORDER_FIELDS, "o_orderkey")
    return s.select("o_orderkey", "o_custkey", "o_orderstatus", r2("o_totalprice").alias("o_totalprice"),
                    ts_text("o_orderdate").alias("o_orderdate"), "o_orderpriority")


SQL_FLATTEN_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 2) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority
FROM orders WHERE o_orderkey IS NOT NULL
"""

# ------------------------------------------------------- A6 re-nest, J6 unnest
ITEM_COLS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_shipdate"]


def orders_with_items(spark, sf_dir) -> DataFrame:
    """Nested orders: one JSON payload per order holding its line items as an
    array (A6), landed as an envelope."""
    li = table(spark, sf_dir, "lineitem")
    nested = jsonx.renest_structs(li, ["l_orderkey"], ITEM_COLS, "l_linenumber", alias="line_items")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    rec = o.join(nested, o.o_orderkey == nested.l_orderkey, "left").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("total"),
        F.col("line_items"))
    return envelope(rec, "orders_nested", TENANT, BATCH, INGESTED_AT, position=rec["order_id"],
                    payload=F.to_json(F.struct(*[F.col(c) for c in rec.columns]), jsonx.TO_JSON_OPTS))


def q_unnest_line_items(spark, sf_dir):
    return unnested_line_items(orders_with_items(spark, sf_dir))


def unnested_line_items(bronze: DataFrame) -> DataFrame:
    v = bronze.select(jsonx.parse("payload").alias("_v"))            # one parse per order
    ex = jsonx.unnest_variant(v, "_v", "line_items", alias="_e")
    return ex.select(
        jsonx.typed("_v", "order_id", "int").alias("l_orderkey"),
        jsonx.typed("_e", "l_linenumber", "int").alias("l_linenumber"),
        jsonx.typed("_e", "l_partkey", "int").alias("l_partkey"),
        r2(jsonx.typed("_e", "l_quantity", "float")).alias("l_quantity"),
        r2(jsonx.typed("_e", "l_extendedprice", "float")).alias("l_extendedprice"),
        ts_text(jsonx.typed("_e", "l_shipdate", "timestamp")).alias("l_shipdate"),
    )


SQL_UNNEST = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
       ROUND(l_quantity, 2) AS l_quantity, ROUND(l_extendedprice, 2) AS l_extendedprice,
       strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS l_shipdate
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
"""


def q_renest_items(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    n = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"),
                                     F.count(F.lit(1)).alias("n_items"), r2(F.sum("l_quantity")).alias("sum_qty"))
    return n.withColumn("items", F.to_json("items", jsonx.TO_JSON_OPTS))


SQL_RENEST = """
SELECT l_orderkey,
       to_json(list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey}
                    ORDER BY l_linenumber, l_partkey, l_suppkey))::VARCHAR AS items,
       COUNT(*) AS n_items, ROUND(SUM(l_quantity), 2) AS sum_qty
FROM lineitem GROUP BY l_orderkey
"""

# ----------------------------------------------------------- E1/E2 typed props


def q_event_props_typed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    v = e.select("event_id", F.col("props").alias("_p"), jsonx.parse("props").alias("_v"))
    return v.select("event_id",
                    jsonx.typed("_v", "k", "int").alias("k"),
                    r2(jsonx.typed("_v", "k", "float")).alias("k_float"),
                    jsonx.text("_p", "k").alias("k_text"),
                    jsonx.strict("_v", "k", "int").alias("k_strict"),
                    jsonx.typed("_v", "missing", "int").alias("missing"))


SQL_EVENT_PROPS = """
SELECT event_id,
       TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       ROUND(TRY_CAST(json_extract(props, '$.k') AS DOUBLE), 2) AS k_float,
       json_extract_string(props, '$.k') AS k_text,
       CAST(json_extract(props, '$.k') AS BIGINT) AS k_strict,
       TRY_CAST(json_extract(props, '$.missing') AS BIGINT) AS missing
FROM events
"""

# ------------------------------------------------------- W3 upsert, W4 ignore
SPLIT_TS = "2024-01-15 00:00:00"
EVENT_COLS = ["user_id", "event_id", "ts", "event_type", "value"]


def _event_halves(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(*EVENT_COLS)
    old = e.filter(F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz"))
    new = e.filter(F.col("ts") >= F.lit(SPLIT_TS).cast("timestamp_ntz"))
    return old, new


def _event_out(df):
    return df.select("user_id", "event_id", ts_text("ts").alias("ts"), "event_type",
                     r2("value").alias("value"))


def q_upsert_events_latest(spark, sf_dir):
    """Silver keyed by user: state from the first half (latest per user),
    then the second half upserted; equals the latest event per user."""
    old, new = _event_halves(spark, sf_dir)
    state = merge.keep_latest(old, "user_id", ["ts", "event_id"])
    return _event_out(merge.upsert(state, new, "user_id", order_by=["ts", "event_id"]))


SQL_UPSERT_LATEST = """
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type,
       ROUND(value, 2) AS value
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events) WHERE rn = 1
"""


def q_insert_ignore_first(spark, sf_dir):
    old, new = _event_halves(spark, sf_dir)
    state = merge.keep_earliest(old, "user_id", ["ts", "event_id"])
    return _event_out(merge.insert_ignore(state, new, "user_id", order_by=["ts", "event_id"]))


SQL_INSERT_IGNORE = """
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type,
       ROUND(value, 2) AS value
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events) WHERE rn = 1
"""


# ------------------------------------------------------ J5 payload-field join


def q_payload_join(spark, sf_dir):
    """J5 two bronze envelopes joined on fields extracted from their payloads
    (orders.o_custkey = customers.c_custkey), order counts per segment."""
    ob = bronze_table(spark, sf_dir, "orders", "o_orderkey")
    cb = bronze_table(spark, sf_dir, "customer", "c_custkey")
    o = ob.select(jsonx.parse("payload").alias("_v")).select(
        jsonx.typed("_v", "o_custkey", "int").alias("ck"), jsonx.typed("_v", "o_totalprice", "float").alias("p"))
    c = cb.select(F.col("payload").alias("_p"), jsonx.parse("payload").alias("_v")).select(
        jsonx.typed("_v", "c_custkey", "int").alias("ck"), jsonx.text("_p", "c_mktsegment").alias("segment"))
    j = o.join(c, "ck")
    return j.groupBy("segment").agg(F.count(F.lit(1)).alias("n_orders"), r2(F.sum("p")).alias("revenue"))


SQL_PAYLOAD_JOIN = """
SELECT c.c_mktsegment AS segment, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1
"""


QUERIES = {
    "payload_join": (q_payload_join, SQL_PAYLOAD_JOIN),
    "revenue_by_day_segment": (q_revenue_by_day_segment, SQL_REVENUE),
    "flatten_orders": (q_flatten_orders, SQL_FLATTEN_ORDERS),
    "unnest_line_items": (q_unnest_line_items, SQL_UNNEST),
    "renest_items": (q_renest_items, SQL_RENEST),
    "event_props_typed": (q_event_props_typed, SQL_EVENT_PROPS),
    "upsert_events_latest": (q_upsert_events_latest, SQL_UPSERT_LATEST),
    "insert_ignore_first": (q_insert_ignore_first, SQL_INSERT_IGNORE),
}
