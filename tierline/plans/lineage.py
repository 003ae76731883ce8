"""Lineage plans (R1-R8, G9).  The catalogue and the stored transforms are
derived from ``supplier`` (they grow with it):

* entities: per supplier s, ``bronze.raw_s{s}``, ``silver.clean_s{s}``,
  ``gold.report_s{s}`` (ids ``e-b-s``, ``e-s-s``, ``e-g-s``);
* ``ta-s`` loads raw -> clean (approved, on_change, watches ``e-b-s``);
* ``tb-s`` builds the report from clean_s{s} JOIN clean_s{m}, m = s XOR 1
  (its neighbour key, absent for the last odd key and for key 1's partner 0);
  for s % 10 = 0 the join names a missing table; approved when s is even;
* ``tc-s`` for s % 7 = 0 names only unknown tables (unresolved edge).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.functions.text import inject_tenant_schemas, strip_tenant_schemas
from tierline.operators import lineage as L
from tierline.plans.common import table, ts_text

TENANT = "t0"


def _suppliers(spark, sf_dir):
    """Each supplier's partner is ``s_suppkey XOR 1`` (its neighbour key); a
    partner that does not exist leaves that join table unresolved."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return s.withColumn("m", F.col("s_suppkey").bitwiseXOR(F.lit(1)))


def entities(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    rows = F.array(F.struct(F.lit("b").alias("p"), F.lit("bronze").alias("layer"), F.lit("raw_s").alias("n")),
                   F.struct(F.lit("s").alias("p"), F.lit("silver").alias("layer"), F.lit("clean_s").alias("n")),
                   F.struct(F.lit("g").alias("p"), F.lit("gold").alias("layer"), F.lit("report_s").alias("n")))
    e = s.select("k", F.inline(rows))
    return e.select(F.concat(F.lit("e-"), "p", F.lit("-"), "k").alias("id"), F.lit(TENANT).alias("tenant_id"),
                    F.concat("n", "k").alias("name"), "layer")


def transforms(spark, sf_dir):
    s = _suppliers(spark, sf_dir)
    k = F.col("s_suppkey").cast("string")
    m = F.col("m").cast("string")
    missing = F.col("s_suppkey") % 10 == 0
    ta = s.select(F.concat(F.lit("ta-"), k).alias("id"), F.concat(F.lit("load_s"), k).alias("name"),
                  F.lit("bronze").alias("source_layer"), F.lit("silver").alias("target_layer"),
                  F.concat(F.lit("INSERT OR REPLACE INTO silver.clean_s"), k,
                           F.lit(" SELECT * FROM bronze.raw_s"), k).alias("transform_sql"),
                  F.lit("approved").alias("status"),
                  F.to_json(F.array(F.concat(F.lit("e-b-"), k))).alias("watch_entities"))
    join_tbl = F.when(missing, F.concat(F.lit("missing_s"), k)).otherwise(F.concat(F.lit("clean_s"), m))
    watch = F.when(missing, F.array(F.concat(F.lit("e-s-"), k))) \
        .otherwise(F.array(F.concat(F.lit("e-s-"), k), F.concat(F.lit("e-s-"), m)))
    tb = s.select(F.concat(F.lit("tb-"), k).alias("id"), F.concat(F.lit("report_s"), k).alias("name"),
                  F.lit("silver").alias("source_layer"), F.lit("gold").alias("target_layer"),
                  F.concat(F.lit("CREATE OR REPLACE TABLE gold.report_s"), k,
                           F.lit(" AS SELECT a.* FROM silver.clean_s"), k,
                           F.lit(" a JOIN silver."), join_tbl, F.lit(" b ON a.k = b.k")).alias("transform_sql"),
                  F.when(F.col("s_suppkey") % 2 == 0, "approved").otherwise("draft").alias("status"),
                  F.to_json(watch).alias("watch_entities"))
    tc = s.filter(F.col("s_suppkey") % 7 == 0).select(
        F.concat(F.lit("tc-"), k).alias("id"), F.concat(F.lit("ghost_s"), k).alias("name"),
        F.lit("silver").alias("source_layer"), F.lit("gold").alias("target_layer"),
        F.concat(F.lit("CREATE TABLE gold.ghost_report_s"), k, F.lit(" AS SELECT * FROM silver.ghost_s"), k)
        .alias("transform_sql"),
        F.lit("draft").alias("status"), F.lit("[]").alias("watch_entities"))
    return ta.unionByName(tb).unionByName(tc).withColumn("tenant_id", F.lit(TENANT)) \
        .withColumn("trigger_mode", F.lit("on_change"))


def q_lineage_edges(spark, sf_dir):
    r = L.resolve(transforms(spark, sf_dir), entities(spark, sf_dir))
    return L.edges(r).select("edge_id", "transform_id", "status", "source_entity_id", "target_entity_id")


_SUPP_SQL = """
WITH s AS (SELECT s_suppkey AS k, s_nationkey, xor(s_suppkey, 1) AS m,
                  xor(s_suppkey, 1) IN (SELECT s_suppkey FROM supplier) AS m_exists
           FROM supplier),
e AS (SELECT 'ta-' || k AS transform_id, 'approved' AS status, 'e-b-' || k AS src, 'e-s-' || k AS tgt FROM s
      UNION ALL
      SELECT 'tb-' || k, CASE WHEN k % 2 = 0 THEN 'approved' ELSE 'draft' END, 'e-s-' || k, 'e-g-' || k FROM s
      UNION ALL
      SELECT 'tb-' || k, CASE WHEN k % 2 = 0 THEN 'approved' ELSE 'draft' END, 'e-s-' || m, 'e-g-' || k FROM s
      WHERE k % 10 <> 0 AND m_exists)
"""
SQL_LINEAGE_EDGES = _SUPP_SQL + """
SELECT transform_id || '_' || src AS edge_id, transform_id, status, src AS source_entity_id,
       tgt AS target_entity_id FROM e
UNION ALL
SELECT 'tc-' || k, 'tc-' || k, 'draft', NULL, NULL FROM s WHERE k % 7 = 0
"""


def q_upstream_closure(spark, sf_dir):
    ents = entities(spark, sf_dir)
    r = L.resolve(transforms(spark, sf_dir), ents)
    up = L.upstream(L.edges(r), ents.filter(F.col("layer") == "gold"))
    return up.select("root", "node", "depth")


SQL_UPSTREAM = _SUPP_SQL + """
, c AS (
  WITH RECURSIVE walk(root, node, depth) AS (
    SELECT tgt, src, 1 FROM e WHERE tgt LIKE 'e-g-%'
    UNION
    SELECT w.root, e.src, w.depth + 1 FROM walk w JOIN e ON e.tgt = w.node WHERE w.depth < 20)
  SELECT root, node, MIN(depth) AS depth FROM walk GROUP BY root, node)
SELECT root, node, depth FROM c
"""


def q_lineage_search(spark, sf_dir):
    """R5 approved edges whose both ends have a '1' in their name."""
    ents = entities(spark, sf_dir)
    e = L.edges(L.resolve(transforms(spark, sf_dir), ents))
    return L.search_filter(e, ents, q="1", status="approved").select("edge_id", "source_entity_id",
                                                                      "target_entity_id")


SQL_LINEAGE_SEARCH = _SUPP_SQL + """
, n AS (SELECT 'e-b-' || s_suppkey AS id, 'raw_s' || s_suppkey AS name FROM supplier
        UNION ALL SELECT 'e-s-' || s_suppkey, 'clean_s' || s_suppkey FROM supplier
        UNION ALL SELECT 'e-g-' || s_suppkey, 'report_s' || s_suppkey FROM supplier)
SELECT transform_id || '_' || src AS edge_id, src AS source_entity_id, tgt AS target_entity_id FROM e
WHERE status = 'approved'
  AND src IN (SELECT id FROM n WHERE name LIKE '%1%') AND tgt IN (SELECT id FROM n WHERE name LIKE '%1%')
"""


def _changed(spark, sf_dir):
    """Entities that got data: the bronze table of every supplier whose key
    is divisible by 3."""
    return entities(spark, sf_dir).filter((F.col("layer") == "bronze") &
                                          (F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 3 == 0))


def q_watchers(spark, sf_dir):
    return L.watchers(transforms(spark, sf_dir), _changed(spark, sf_dir)).select("entity_id", "transform_id")


SQL_WATCHERS = """
SELECT 'e-b-' || s_suppkey AS entity_id, 'ta-' || s_suppkey AS transform_id FROM supplier WHERE s_suppkey % 3 = 0
"""


def q_cascade_plan(spark, sf_dir):
    t = transforms(spark, sf_dir)
    r = L.resolve(t, entities(spark, sf_dir))
    return L.cascade_plan(t, r, _changed(spark, sf_dir)).select("transform_id", "depth")


SQL_CASCADE = _SUPP_SQL + """
, w AS (SELECT 'ta-' || k AS tid, 'e-b-' || k AS watched, 'e-s-' || k AS target FROM s
        UNION ALL SELECT 'tb-' || k, 'e-s-' || k, 'e-g-' || k FROM s WHERE k % 2 = 0
        UNION ALL SELECT 'tb-' || k, 'e-s-' || m, 'e-g-' || k FROM s WHERE k % 2 = 0 AND k % 10 <> 0),
plan AS (
  WITH RECURSIVE p(tid, target, depth) AS (
    SELECT tid, target, 0 FROM w WHERE watched IN (SELECT 'e-b-' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)
    UNION
    SELECT w.tid, w.target, p.depth + 1 FROM p JOIN w ON w.watched = p.target WHERE p.depth < 4)
  SELECT tid, MIN(depth) AS depth FROM p GROUP BY tid)
SELECT tid AS transform_id, depth FROM plan
"""


def q_debounce(spark, sf_dir):
    """R8 per user, events that fire under a 30 s debounce."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    d = L.debounce(e, "user_id", "ts", "event_id")
    return d.select("user_id", "event_id", ts_text("ts").alias("ts"))


SQL_DEBOUNCE = """
WITH RECURSIVE o AS (SELECT user_id, event_id, ts,
                            ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f(user_id, rn, last_fired, fired, event_id, ts) AS (
  SELECT user_id, rn, ts, true, event_id, ts FROM o WHERE rn = 1
  UNION ALL
  SELECT o.user_id, o.rn,
         CASE WHEN o.ts - f.last_fired >= INTERVAL 30 SECOND THEN o.ts ELSE f.last_fired END,
         o.ts - f.last_fired >= INTERVAL 30 SECOND, o.event_id, o.ts
  FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM f WHERE fired
"""


def q_tenant_sql_rewrite(spark, sf_dir):
    """G9 stored SQL made tenant-scoped for execution, then portable again."""
    t = transforms(spark, sf_dir)
    scoped = t.select("id", inject_tenant_schemas(F.col("transform_sql"), F.lit("Acme-Corp")).alias("scoped"))
    return scoped.select("id", "scoped", strip_tenant_schemas(F.col("scoped")).alias("portable"))


SQL_TENANT_REWRITE = _SUPP_SQL + """
, t AS (SELECT 'ta-' || k AS id, 'INSERT OR REPLACE INTO silver.clean_s' || k || ' SELECT * FROM bronze.raw_s' || k AS q
        FROM s
        UNION ALL
        SELECT 'tb-' || k, 'CREATE OR REPLACE TABLE gold.report_s' || k || ' AS SELECT a.* FROM silver.clean_s' || k ||
               ' a JOIN silver.' || CASE WHEN k % 10 = 0 THEN 'missing_s' || k ELSE 'clean_s' || m END ||
               ' b ON a.k = b.k' FROM s
        UNION ALL
        SELECT 'tc-' || k, 'CREATE TABLE gold.ghost_report_s' || k || ' AS SELECT * FROM silver.ghost_s' || k
        FROM s WHERE k % 7 = 0)
SELECT id, replace(replace(replace(q, 'bronze.', 'bronze_acme_corp.'), 'silver.', 'silver_acme_corp.'),
                   'gold.', 'gold_acme_corp.') AS scoped, q AS portable FROM t
"""

QUERIES = {
    "lineage_edges": (q_lineage_edges, SQL_LINEAGE_EDGES),
    "upstream_closure": (q_upstream_closure, SQL_UPSTREAM),
    "lineage_search": (q_lineage_search, SQL_LINEAGE_SEARCH),
    "watchers": (q_watchers, SQL_WATCHERS),
    "cascade_plan": (q_cascade_plan, SQL_CASCADE),
    "debounce": (q_debounce, SQL_DEBOUNCE),
    "tenant_sql_rewrite": (q_tenant_sql_rewrite, SQL_TENANT_REWRITE),
}
