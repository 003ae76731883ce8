"""Storage and write-path plans (S13-S17, W1, W2, W5, W8, W9, W11-W13, E10,
E18).  Tables are written below a fresh folder of the shared checkpoint root
and read back, so the plans exercise real Parquet writes."""

from __future__ import annotations


from pyspark.sql import functions as F

from tierline.functions.text import search_any
from tierline.operators import flatten as fl
from tierline.operators import governance as G
from tierline.operators import merge
from tierline.operators.introspect import visible_tables
from tierline.operators.infer import infer_fields
from tierline.plans import control, lineage as lin
from tierline.plans.common import BATCH, TENANT, dealt, r2, table, ts_text
from tierline.session import cut_lineage, scratch_dir, staged
from tierline.sources import sinks
from tierline.sources.landing import envelope

SPLIT = "2024-01-15 00:00:00"


def q_bronze_roundtrip(spark, sf_dir):
    """S14 two landing batches appended to a date-partitioned bronze table;
    S13 read back by landing date (partition pruning)."""
    e = table(spark, sf_dir, "events")
    root = scratch_dir(spark, "bronze")
    path = sinks.layer_path(root, TENANT, "bronze", "events")
    early = e.filter(F.col("ts") < F.lit(SPLIT).cast("timestamp_ntz"))
    late = e.filter(F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz"))
    sinks.append_bronze(envelope(early, "events", TENANT, BATCH, "2024-02-01T00:00:00", position="event_id"), path)
    sinks.append_bronze(envelope(late, "events", TENANT, "batch-0002", "2024-02-02T00:00:00",
                                 position="event_id"), path)
    b = sinks.read_bronze(spark, path, ["2024-02-01", "2024-02-02"])
    v = b.select(F.try_parse_json("payload").alias("v"), F.col("ingest_date").cast("string").alias("ingest_date"))
    return v.select("ingest_date", F.try_variant_get("v", "$.event_type", "string").alias("event_type")) \
        .groupBy("ingest_date", "event_type").agg(F.count(F.lit(1)).alias("n"))


SQL_BRONZE_ROUNDTRIP = f"""
SELECT CASE WHEN ts < TIMESTAMP '{SPLIT}' THEN '2024-02-01' ELSE '2024-02-02' END AS ingest_date, event_type, COUNT(*) AS n
FROM events GROUP BY ALL
"""


def q_replace_versions(spark, sf_dir):
    """W2 create the gold table when missing, W1 / S15 replace it twice;
    readers see the last complete version."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = sinks.layer_path(scratch_dir(spark, "gold"), TENANT, "gold", "orders_by_status")
    sinks.create_if_missing(spark, path, o.schema)
    sinks.replace_table(spark, o.filter(F.col("o_orderstatus") == "F"), path)
    sinks.replace_table(spark, o.filter(F.col("o_orderstatus") == "O"), path)
    out = sinks.read_table(spark, path)
    return out.select("o_orderkey", "o_orderstatus", r2("o_totalprice").alias("o_totalprice"))


SQL_REPLACE_VERSIONS = """
SELECT o_orderkey, o_orderstatus, ROUND(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'O'
"""


def q_upsert_buckets(spark, sf_dir):
    """W3 on storage: all orders upserted into a bucketed table, then a batch
    with every key twice for a hundredth of the orders and some new keys."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = sinks.layer_path(scratch_dir(spark, "upsert"), TENANT, "silver", "orders")
    sinks.upsert_table(spark, path, o, "o_orderkey", n_buckets=16)
    some = o.filter(F.col("o_orderkey") % 100 == 0)
    batch = (some.withColumn("o_orderstatus", F.lit("A")).unionByName(some.withColumn("o_orderstatus", F.lit("Z")))
             .unionByName(some.withColumn("o_orderkey", -F.col("o_orderkey") - 1)))
    sinks.upsert_table(spark, path, batch, "o_orderkey", order_by=["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", r2("o_totalprice").alias("o_totalprice"))


SQL_UPSERT_BUCKETS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
       ROUND(o_totalprice, 2) AS o_totalprice FROM orders
UNION ALL SELECT -o_orderkey - 1, o_orderstatus, ROUND(o_totalprice, 2) FROM orders WHERE o_orderkey % 100 = 0
"""


def q_run_trail(spark, sf_dir):
    """S16 one run row per daily batch with a nested detail column stored as
    JSON text."""
    e = table(spark, sf_dir, "events")
    runs = e.groupBy(F.to_date("ts").cast("string").alias("batch")).agg(
        F.create_map(F.lit("error"), F.count_if(F.col("event_type") == "error"),
                     F.lit("ok"), F.count_if(F.col("event_type") != "error")).alias("detail"),
        F.count(F.lit(1)).alias("records_in"))
    path = scratch_dir(spark, "runs")
    sinks.append_run(runs, path)
    return spark.read.parquet(path)


SQL_RUN_TRAIL = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch,
       '{"error":' || COUNT(*) FILTER (WHERE event_type = 'error') || ',"ok":'
         || COUNT(*) FILTER (WHERE event_type <> 'error') || '}' AS detail,
       COUNT(*) AS records_in
FROM events GROUP BY 1
"""


def q_audit_append(spark, sf_dir):
    """W9 audit events appended partitioned by day, read back by day."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("id"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))
                   .alias("tenant_id"), "user_id", F.col("event_type").alias("action"),
                   F.col("ts").alias("created_at"))
    path = scratch_dir(spark, "audit")
    sinks.append_audit(log, path)
    held = spark.read.parquet(path).withColumn("day", F.col("day").cast("string"))
    return held.groupBy("day", "tenant_id", "action").agg(F.count(F.lit(1)).alias("n"))


SQL_AUDIT_APPEND = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id, event_type AS action,
       COUNT(*) AS n
FROM events GROUP BY ALL
"""


def q_schema_evolution(spark, sf_dir):
    """W8 a column added by a later append; old rows read it as null (or the
    declared default when added with ``add_column_if_missing``)."""
    o = table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "evolve")
    old = o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    new = o.filter(F.col("o_orderstatus") != "F").select("o_orderkey", "o_totalprice", "o_orderpriority")
    old.write.parquet(path)
    sinks.append_with_new_columns(spark, new, path)
    t = spark.read.option("mergeSchema", "true").parquet(path)
    t = merge.add_column_if_missing(t, "collection", "default", "string")
    return t.select("o_orderkey", r2("o_totalprice").alias("o_totalprice"), "o_orderpriority", "collection")


SQL_SCHEMA_EVOLUTION = """
SELECT o_orderkey, ROUND(o_totalprice, 2) AS o_totalprice,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       'default' AS collection
FROM orders
"""


def q_config_conflict_update(spark, sf_dir):
    """W5 ``ON CONFLICT (tenant, key) DO UPDATE SET value``: the overlay of
    every supplier tenant (E16) updated by one write per even supplier, plus
    a new key for those tenants."""
    t = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey")
    stored = G.config_overlay(t.select("id"), spark.createDataFrame([], "tenant_id string, key string, value string"))
    stored = stored.withColumn("updated_by", F.lit("seed"))
    ev = t.filter(F.col("s_suppkey") % 2 == 0)
    writes = ev.select(F.col("id").alias("tenant_id"), F.lit("data_retention_days").alias("key"),
                       (F.col("s_suppkey") + 30).cast("string").alias("value")) \
        .unionByName(ev.select(F.col("id").alias("tenant_id"), F.lit("theme").alias("key"),
                               F.lit('"dark"').alias("value")))
    return merge.conflict_update(stored, writes, ["tenant_id", "key"], ["value"])


_DEF = ", ".join(f"('{k}', '{v}')" for k, v in G.CONFIG_DEFAULTS.items())
SQL_CONFIG_CONFLICT = f"""
WITH d AS (SELECT * FROM (VALUES {_DEF}) AS v(key, value)),
s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS tenant_id, d.key, d.value, 'seed' AS updated_by
      FROM supplier CROSS JOIN d),
w AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS tenant_id, 'data_retention_days' AS key,
             CAST(s_suppkey + 30 AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL
      SELECT 's' || CAST(s_suppkey AS VARCHAR), 'theme', '"dark"' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT COALESCE(s.tenant_id, w.tenant_id) AS tenant_id, COALESCE(s.key, w.key) AS key,
       CASE WHEN w.key IS NOT NULL THEN w.value ELSE s.value END AS value, s.updated_by
FROM s FULL OUTER JOIN w ON s.tenant_id = w.tenant_id AND s.key = w.key
"""


def q_one_call_import(spark, sf_dir):
    """W11 import: land -> infer -> key guess -> flatten, on every event."""
    e = dealt(table(spark, sf_dir, "events"))
    bronze = envelope(e, "events", TENANT, BATCH, "2024-02-01T00:00:00", position=F.col("event_id")) \
        .withColumn("_pos", F.get_json_object("payload", "$.event_id").cast("long"))
    bronze = staged(bronze, "import-bronze")                                  # landed once; inference and silver read it
    fields = cut_lineage(infer_fields(bronze, "_pos", entity_name="events"))  # one row a field
    pk = [r["name"] for r in fields.filter("is_pk").select("name").collect()]   # one row: schema
    tuples = fl.field_tuples(fields)                                          # schema-sized list
    silver = fl.flatten(bronze, tuples, pk[0] if pk else tuples[0][0])
    return silver.select("event_id", ts_text("ts").alias("ts"), "user_id", "event_type",
                         r2("value").alias("value"), "props")


SQL_ONE_CALL_IMPORT = """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, ROUND(value, 2) AS value, props
FROM events
"""


def q_transform_run(spark, sf_dir):
    """An approved transform's stored SQL runs (and a draft one is
    refused); the run rows carry status and rows produced."""
    o = table(spark, sf_dir, "orders")
    sql = "CREATE OR REPLACE TABLE gold.by_priority AS SELECT o_orderpriority, count(*) AS n FROM silver.orders GROUP BY o_orderpriority"
    args = {"tables": {"silver.orders": o}, "root": scratch_dir(spark, "transform"), "tenant": TENANT}
    ok = fl.run_transform(spark, {"id": "t-gold", "status": "approved", "transform_sql": sql}, run_id="r1", **args)
    no = fl.run_transform(spark, {"id": "t-draft", "status": "draft", "transform_sql": sql}, run_id="r2", **args)
    src_ok = fl.non_empty(o)
    return ok.run.unionByName(no.run).select("transform_id", "status", "rows_produced",
                                             F.lit(src_ok).alias("source_non_empty"))


def q_transform_stored_sql(spark, sf_dir):
    """W12 a two-statement upsert transform, run twice over changed orders:
    the silver table it leaves, with the last run's status and count."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t = {"id": "t-silver", "status": "approved", "key": "o_orderkey", "transform_sql": """
        CREATE TABLE IF NOT EXISTS silver.orders AS SELECT o_orderkey, o_orderstatus, o_totalprice FROM bronze.orders WHERE o_orderkey % 2 = 0;
        INSERT OR REPLACE INTO silver.orders SELECT o_orderkey, 'x;y' AS o_orderstatus, o_totalprice FROM bronze.orders WHERE o_orderkey % 3 = 0"""}
    root = scratch_dir(spark, "stored-transform")
    fl.run_transform(spark, t, {"bronze.orders": o}, root, TENANT, run_id="r1")
    again = o.withColumn("o_orderkey", F.col("o_orderkey") + 1)
    done = fl.run_transform(spark, t, {"bronze.orders": again}, root, TENANT, run_id="r2")
    return done.output.select("o_orderkey", "o_orderstatus").crossJoin(done.run.select("status", "rows_produced"))   # one row


SQL_TRANSFORM_STORED = """
WITH first AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x;y' ELSE o_orderstatus END AS o_orderstatus FROM orders
               WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0),
later AS (SELECT o_orderkey + 1 AS o_orderkey, 'x;y' AS o_orderstatus FROM orders WHERE (o_orderkey + 1) % 3 = 0),
merged AS (SELECT * FROM later UNION ALL SELECT * FROM first WHERE o_orderkey NOT IN (SELECT o_orderkey FROM later))
SELECT *, 'success' AS status, (SELECT COUNT(*) FROM merged) AS rows_produced FROM merged
"""


def q_import_chain(spark, sf_dir):
    """W11 + W12 the whole chain: customers as a CSV file, imported in one call,
    the draft approved and run.  The silver rows, with what was registered."""
    from tierline.operators.imports import control_path, import_file
    c = dealt(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))
    src, root = scratch_dir(spark, "import-src"), scratch_dir(spark, "import")
    c.write.option("header", True).csv(src)
    import_file(spark, src, "csv", "Customers", TENANT, root, BATCH, "2024-02-01T00:00:00")
    draft = spark.read.parquet(control_path(root, "transforms")).first().asDict()
    bronze = sinks.read_bronze(spark, sinks.layer_path(root, TENANT, "bronze", "customers"))
    done = fl.run_transform(spark, {**draft, "status": "approved"}, {"bronze.customers": bronze}, root, TENANT)
    n_fields = spark.read.parquet(control_path(root, "fields")).filter(F.col("entity_id").contains(".bronze.")).agg(F.count(F.lit(1)).alias("n_fields"))
    n_records = spark.read.parquet(control_path(root, "entities")).filter("layer = 'bronze'").select("n_records")
    return (done.output.select("c_custkey", "c_name", r2("c_acctbal").alias("c_acctbal"), "c_mktsegment")
            .crossJoin(n_fields).crossJoin(n_records))          # one row each


def q_import_twice(spark, sf_dir):
    """W11 + W12 customers as JSON lines, with a quote in one name and two
    names that differ in case, imported twice: the silver rows of the approved
    draft, with the numbers of registered rows and what the draft watches."""
    from tierline.operators import imports
    c = dealt(table(spark, sf_dir, "customer"))
    body = F.to_json(F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("ID"), F.concat(F.lit("x"), F.col("c_custkey")),
                                  F.lit("it's"), F.col("c_mktsegment"), F.lit("a`b"), F.col("c_name")))
    root = scratch_dir(spark, "import-twice")
    for n in (1, 2):
        done = imports.import_records(spark, c.select(body.alias("payload"), "c_custkey"), "Customers", TENANT, root, f"{BATCH}-{n}",
                                      f"2024-02-0{n}T00:00:00", position="c_custkey", key="id")
    draft = done.transform.first().asDict()
    bronze = sinks.read_bronze(spark, sinks.layer_path(root, TENANT, "bronze", "customers"))
    ran = fl.run_transform(spark, {**draft, "status": "approved"}, {"bronze.customers": bronze}, root, TENANT)
    counts = [imports.control_table(spark, root, t).agg(F.count(F.lit(1)).alias(f"n_{t}")) for t in ("entities", "fields", "transforms")]
    out = ran.output.select(F.col("id").alias("id"), F.col("ID_2").alias("id_2"), F.col("`it's`").alias("quoted"), F.col("`a``b`").alias("ticked"),
                            F.lit(draft["watch_entities"][0]).alias("watches"))
    for n in (*counts, ran.run.select("status", "rows_produced")):
        out = out.crossJoin(n)                                   # one row each
    return out


SQL_IMPORT_TWICE = f"""
SELECT CAST(c_custkey AS VARCHAR) AS id, 'x' || c_custkey AS id_2, c_mktsegment AS quoted, c_name AS ticked, '{TENANT}.bronze.customers' AS watches,
       2::BIGINT AS n_entities, 8::BIGINT AS n_fields, 1::BIGINT AS n_transforms, 'success' AS status, (SELECT COUNT(*) FROM customer) AS rows_produced
FROM customer
"""


def q_transform_declared(spark, sf_dir):
    """W12 stored SQL as other tools write it: comments with quotes and
    semicolons, declared columns with a primary key, JSON functions by other
    names, a temporary table, and a bare query at the end; run twice, over all
    orders and over the same with another status."""
    o = table(spark, sf_dir, "orders")
    sql = r"""-- what's loaded; nothing is dropped
        CREATE TABLE IF NOT EXISTS silver.orders_typed (
            o_orderkey BIGINT PRIMARY KEY, status VARCHAR, /* it's; */ price DOUBLE
        );
        CREATE TEMP TABLE silver.staged AS SELECT payload FROM bronze.orders WHERE payload <> ';--';
        INSERT OR REPLACE INTO silver.orders_typed (o_orderkey, price, status)
        SELECT TRY_CAST(json_extract(payload, '$.o_orderkey') AS BIGINT) AS o_orderkey,
               TRY_CAST(json_extract(payload, '$.o_totalprice') AS DOUBLE) AS price,
               concat(json_extract_string(payload, '$.o_orderstatus'), '\'; --') AS status   -- the last; column
        FROM silver.staged WHERE json_extract_string(payload, '$.o_orderkey') IS NOT NULL;
        SELECT count(*) AS n FROM silver.orders_typed;"""
    t = {"id": "t-typed", "status": "approved", "transform_sql": sql}
    root = scratch_dir(spark, "declared-transform")
    for status in (F.lit("?"), F.col("o_orderstatus")):
        rows = o.withColumn("o_orderstatus", status).select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("payload"))
        done = fl.run_transform(spark, t, {"bronze.orders": rows}, root, TENANT)
    return done.output.select("o_orderkey", "status", r2("price").alias("price")).crossJoin(
        done.run.select(F.col("status").alias("run_status"), "rows_produced"))   # one row


SQL_TRANSFORM_DECLARED = """
SELECT o_orderkey, o_orderstatus || '''; --' AS status, ROUND(o_totalprice, 2) AS price, 'success' AS run_status,
       (SELECT COUNT(*) FROM orders) AS rows_produced FROM orders
"""


SQL_IMPORT_CHAIN = """
SELECT c_custkey, c_name, ROUND(c_acctbal, 2) AS c_acctbal, c_mktsegment, 4::BIGINT AS n_fields,
       (SELECT COUNT(*) FROM customer) AS n_records FROM customer
"""


def q_tenant_scoped(spark, sf_dir):
    """G7 the memberships that one tenant's reader returns, by role."""
    read = G.TenantReader({"memberships": control.memberships(spark, sf_dir)}, "t1")
    return read("memberships").groupBy("tenant_id", "role").agg(F.count(F.lit(1)).alias("n"))


SQL_TENANT_SCOPED = """
SELECT 't1' AS tenant_id, ['owner', 'admin', 'engineer', 'analyst', 'viewer'][c_custkey % 5 + 1] AS role, COUNT(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY ALL
"""


SQL_TRANSFORM_RUN = """
SELECT 't-gold' AS transform_id, 'success' AS status, (SELECT COUNT(DISTINCT o_orderpriority) FROM orders)
         AS rows_produced, true AS source_non_empty
UNION ALL SELECT 't-draft', 'failed', 0, true
"""


def q_visible_tables(spark, sf_dir):
    """S17 tables an analyst may query (silver and gold)."""
    ents = control.catalogue_entities(spark, sf_dir)
    return visible_tables(ents, G.layers_for("analyst"))


SQL_VISIBLE_TABLES = """
SELECT 't0' AS tenant_id, 'part_' || p_partkey AS name,
       CASE p_size % 3 WHEN 1 THEN 'silver' ELSE 'gold' END AS layer
FROM part WHERE p_size % 3 IN (1, 2)
"""


def q_legacy_sql_rewrite(spark, sf_dir):
    """E10 + W6: stored SQL that reads silver but not a missing table is
    rewritten (``UPDATE ... SET sql = ... WHERE lower(sql) LIKE ... AND NOT
    LIKE ...``); other rows keep their text."""
    t = lin.transforms(spark, sf_dir)
    low = F.lower("transform_sql")
    pred = low.like("%from silver.%") & ~low.like("%missing_%")
    out = merge.rewrite(t, pred, {"transform_sql": F.regexp_replace("transform_sql", r"SELECT a\.\*", "SELECT a.k")})
    return out.select("id", "transform_sql")


SQL_LEGACY_REWRITE = lin._SUPP_SQL + """
, t AS (SELECT 'ta-' || k AS id, 'INSERT OR REPLACE INTO silver.clean_s' || k || ' SELECT * FROM bronze.raw_s' || k AS q
        FROM s
        UNION ALL
        SELECT 'tb-' || k, 'CREATE OR REPLACE TABLE gold.report_s' || k || ' AS SELECT a.* FROM silver.clean_s' || k ||
               ' a JOIN silver.' || CASE WHEN k % 10 = 0 THEN 'missing_s' || k ELSE 'clean_s' || m END ||
               ' b ON a.k = b.k' FROM s
        UNION ALL
        SELECT 'tc-' || k, 'CREATE TABLE gold.ghost_report_s' || k || ' AS SELECT * FROM silver.ghost_s' || k
        FROM s WHERE k % 7 = 0)
SELECT id, CASE WHEN lower(q) LIKE '%from silver.%' AND lower(q) NOT LIKE '%missing_%'
                THEN replace(q, 'SELECT a.*', 'SELECT a.k') ELSE q END AS transform_sql
FROM t
"""


def q_search_entities(spark, sf_dir):
    """E18 case-insensitive search over name and description, and-ed with an
    exact collection filter, counted per layer."""
    ents = control.catalogue_entities(spark, sf_dir)
    hit = ents.filter(search_any(["name", "description"], "eDiU") & (F.col("collection") == "Brand#13"))
    return hit.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


SQL_SEARCH_ENTITIES = """
SELECT CASE p_size % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS layer, COUNT(*) AS n
FROM part WHERE (contains(lower('part_' || p_partkey), 'ediu') OR contains(lower(p_type), 'ediu'))
  AND p_brand = 'Brand#13'
GROUP BY 1
"""

QUERIES = {
    "import_chain": (q_import_chain, SQL_IMPORT_CHAIN),
    "tenant_scoped": (q_tenant_scoped, SQL_TENANT_SCOPED),
    "import_twice": (q_import_twice, SQL_IMPORT_TWICE),
    "transform_declared": (q_transform_declared, SQL_TRANSFORM_DECLARED),
    "transform_stored_sql": (q_transform_stored_sql, SQL_TRANSFORM_STORED),
    "upsert_buckets": (q_upsert_buckets, SQL_UPSERT_BUCKETS),
    "bronze_roundtrip": (q_bronze_roundtrip, SQL_BRONZE_ROUNDTRIP),
    "replace_versions": (q_replace_versions, SQL_REPLACE_VERSIONS),
    "run_trail": (q_run_trail, SQL_RUN_TRAIL),
    "audit_append": (q_audit_append, SQL_AUDIT_APPEND),
    "schema_evolution": (q_schema_evolution, SQL_SCHEMA_EVOLUTION),
    "config_conflict_update": (q_config_conflict_update, SQL_CONFIG_CONFLICT),
    "one_call_import": (q_one_call_import, SQL_ONE_CALL_IMPORT),
    "transform_run": (q_transform_run, SQL_TRANSFORM_RUN),
    "visible_tables": (q_visible_tables, SQL_VISIBLE_TABLES),
    "legacy_sql_rewrite": (q_legacy_sql_rewrite, SQL_LEGACY_REWRITE),
    "search_entities": (q_search_entities, SQL_SEARCH_ENTITIES),
}
