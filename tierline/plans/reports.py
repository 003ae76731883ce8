"""Operations report plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.operators import merge
from tierline.operators import query as Q
from tierline.operators import reports as R
from tierline.plans import control
from tierline.plans.common import r2, table, ts_text

AS_OF = "2024-01-31"
DAYS = 14


def _runs(spark, sf_dir):
    r = control.runs(spark, sf_dir)
    cr = r.filter(F.col("kind") == "connector").select(
        "id", F.col("job_id").alias("integration_id"), "status", "started_at", "completed_at",
        "records_in", "records_out", (F.col("records_in") - F.col("records_out")).alias("records_rejected"),
        F.when(F.col("status") == "failed", F.lit("error event")).alias("error_detail"))
    tr = r.filter(F.col("kind") == "transform").select(
        "id", F.col("job_id").alias("transform_id"), "status", "started_at", "completed_at",
        F.col("records_out").alias("rows_produced"))
    return cr, tr


def _jobs(spark, sf_dir, tenant=None):
    cr, tr = _runs(spark, sf_dir)
    return R.jobs_union(cr, control.connectors(spark, sf_dir), tr, control.transforms(spark, sf_dir), tenant)


def _job_out(df):
    return df.select("id", "job_type", "job_name", "sub_type", "status", ts_text("started_at").alias("started_at"),
                     "records_in", "records_out", "records_rejected", "error_detail")


_JOBS_SQL = """
WITH r AS (SELECT event_id AS id, user_id, 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
                  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'partial'
                       ELSE 'success' END AS status, ts AS started_at,
                  CAST(floor(value) AS BIGINT) AS n_in FROM events),
r2 AS (SELECT *, CASE WHEN status = 'failed' THEN 0 WHEN status = 'partial' THEN CAST(trunc(n_in / 2) AS BIGINT)
                      ELSE n_in END AS n_out FROM r),
jobs AS (
  SELECT id, 'connector' AS job_type, 'conn_' || CAST(user_id AS VARCHAR) AS job_name,
         ['webhook', 'csv', 'api'][(user_id % 3) + 1] AS sub_type, status, started_at,
         n_in AS records_in, n_out AS records_out, n_in - n_out AS records_rejected,
         CASE WHEN status = 'failed' THEN 'error event' END AS error_detail, tenant_id
  FROM r2 WHERE user_id % 2 = 0
  UNION ALL
  SELECT id, 'transform', 'tf_' || CAST(user_id AS VARCHAR), ['silver', 'gold', 'silver'][(user_id % 3) + 1],
         status, started_at, n_out, n_out, 0, NULL, tenant_id
  FROM r2 WHERE user_id % 2 = 1)
"""


def q_jobs_feed(spark, sf_dir):
    """O1 page 2 (50 per page) of tenant t1's jobs, newest first."""
    return _job_out(R.jobs_feed(_jobs(spark, sf_dir, "t1"), page_no=2, page_size=50))


SQL_JOBS_FEED = _JOBS_SQL + """
SELECT id, job_type, job_name, sub_type, status, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
       records_in, records_out, records_rejected, error_detail
FROM jobs WHERE tenant_id = 't1' ORDER BY started_at DESC, job_type, id LIMIT 50 OFFSET 50
"""


def q_jobs_total(spark, sf_dir):
    """A5 total for paging, per tenant."""
    return _jobs(spark, sf_dir).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("total"))


SQL_JOBS_TOTAL = _JOBS_SQL + "SELECT tenant_id, COUNT(*) AS total FROM jobs GROUP BY tenant_id"


def q_daily_stats(spark, sf_dir):
    d = R.daily_stats(_jobs(spark, sf_dir), AS_OF, DAYS)
    return d.select(F.col("day").cast("string").alias("day"), "job_type", "total", "success", "failed", "partial")


SQL_DAILY_STATS = _JOBS_SQL + f"""
SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, job_type, COUNT(*) AS total,
       SUM(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS success,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed,
       COUNT(*) FILTER (WHERE status = 'partial') AS partial
FROM jobs WHERE started_at >= DATE '{AS_OF}' - INTERVAL {DAYS} DAY
GROUP BY ALL
"""


def q_activity_grid(spark, sf_dir):
    d = R.daily_stats(_jobs(spark, sf_dir), AS_OF, DAYS)
    g = R.activity_grid(d, "2024-01-17", AS_OF, ["connector", "transform"])
    return g.select(F.col("day").cast("string").alias("day"), "connector", "transform", "stacked", "max_stacked")


SQL_ACTIVITY_GRID = _JOBS_SQL + f"""
, d AS (SELECT CAST(started_at AS DATE) AS day, job_type, COUNT(*) AS n FROM jobs
        WHERE started_at >= DATE '{AS_OF}' - INTERVAL {DAYS} DAY GROUP BY ALL),
g AS (SELECT CAST(day AS DATE) AS day FROM generate_series(DATE '2024-01-17', DATE '{AS_OF}', INTERVAL 1 DAY) t(day)),
w AS (SELECT g.day,
             COALESCE((SELECT n FROM d WHERE d.day = g.day AND job_type = 'connector'), 0) AS connector,
             COALESCE((SELECT n FROM d WHERE d.day = g.day AND job_type = 'transform'), 0) AS transform
      FROM g)
SELECT CAST(day AS VARCHAR) AS day, connector, transform, connector + transform AS stacked,
       MAX(connector + transform) OVER () AS max_stacked FROM w
"""


def q_totals(spark, sf_dir):
    cr, tr = _runs(spark, sf_dir)
    return R.totals(control.tenants(spark, sf_dir), control.connectors(spark, sf_dir), cr,
                    control.transforms(spark, sf_dir), tr)


SQL_TOTALS = """
WITH u AS (SELECT user_id, 't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id FROM events)
SELECT 't' || CAST(r_regionkey AS VARCHAR) AS tenant_id,
       (SELECT COUNT(DISTINCT user_id) FROM u WHERE u.tenant_id = 't' || CAST(r_regionkey AS VARCHAR)
          AND user_id % 2 = 0) AS total_connectors,
       (SELECT COUNT(DISTINCT user_id) FROM u WHERE u.tenant_id = 't' || CAST(r_regionkey AS VARCHAR)
          AND user_id % 2 = 1) AS total_transforms,
       (SELECT COUNT(*) FROM u WHERE u.tenant_id = 't' || CAST(r_regionkey AS VARCHAR)
          AND user_id % 2 = 0) AS total_connector_runs,
       (SELECT COUNT(*) FROM u WHERE u.tenant_id = 't' || CAST(r_regionkey AS VARCHAR)
          AND user_id % 2 = 1) AS total_transform_runs
FROM region
"""


def q_audit_log_page(spark, sf_dir):
    """O4 E9 + L5: tenant t2's ``click`` entries, page 1 of 20 (the total is
    the same filter counted, as in ``jobs_total``)."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("id"),
                   F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
                   "user_id", F.col("event_type").alias("action"),
                   F.when(F.col("user_id") % 2 == 0, "connector").otherwise("transform").alias("resource_type"),
                   F.col("ts").alias("created_at"))
    from tierline.functions.text import exact_filters
    f = log.filter(exact_filters(tenant_id="t2", action="click", resource_type=None))
    pg = Q.page(f, [F.col("created_at").desc(), F.col("id").desc()], 1, 20)
    return pg.select("id", "user_id", "action", "resource_type", ts_text("created_at").alias("created_at"))


SQL_AUDIT_LOG_PAGE = """
WITH f AS (SELECT event_id AS id, user_id, event_type AS action,
                  CASE WHEN user_id % 2 = 0 THEN 'connector' ELSE 'transform' END AS resource_type, ts
           FROM events WHERE 't' || CAST(user_id % 5 AS VARCHAR) = 't2' AND event_type = 'click')
SELECT id, user_id, action, resource_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at
FROM f ORDER BY ts DESC, id DESC LIMIT 20
"""


def q_collections_summary(spark, sf_dir):
    return R.collections_summary(control.catalogue_entities(spark, sf_dir), control.transforms(spark, sf_dir),
                                 control.connectors(spark, sf_dir))


SQL_COLLECTIONS = """
WITH u AS (SELECT p_brand AS collection, 'entity' AS kind FROM part
           UNION ALL SELECT DISTINCT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR), 'transform' || user_id
           FROM events WHERE user_id % 2 = 1
           UNION ALL SELECT DISTINCT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR), 'connector' || user_id
           FROM events WHERE user_id % 2 = 0)
SELECT collection, COUNT(*) FILTER (WHERE kind = 'entity') AS entity_count,
       COUNT(*) FILTER (WHERE kind LIKE 'transform%') AS transform_count,
       COUNT(*) FILTER (WHERE kind LIKE 'connector%') AS connector_count
FROM u GROUP BY collection
"""


def q_tenant_members(spark, sf_dir):
    return R.tenant_members(control.tenants(spark, sf_dir), control.memberships(spark, sf_dir))


SQL_TENANT_MEMBERS = """
WITH m AS (SELECT n.n_regionkey AS rk, c.c_acctbal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT 't' || CAST(r_regionkey AS VARCHAR) AS tenant_id, regexp_replace(lower(r_name), '[^a-z0-9]', '_', 'g') AS slug,
       r_name AS name,
       (SELECT COUNT(*) FROM m WHERE m.rk = r_regionkey) AS member_count,
       (SELECT COUNT(*) FROM m WHERE m.rk = r_regionkey AND c_acctbal >= 0) AS active_count
FROM region
"""


def q_member_list(spark, sf_dir):
    return R.member_list(control.memberships(spark, sf_dir), control.users(spark, sf_dir), "t1")


SQL_MEMBER_LIST = """
SELECT c.c_custkey AS user_id, lower(replace(c.c_name, '#', '.')) || '@example.com' AS email,
       c.c_name AS display_name, ['owner', 'admin', 'engineer', 'analyst', 'viewer'][(c.c_custkey % 5) + 1] AS role,
       CASE WHEN c.c_acctbal < 0 THEN '2024-01-01 00:00:00' END AS revoked_at, c.c_acctbal >= 0 AS active
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1
"""


def q_run_history(spark, sf_dir):
    cr, _ = _runs(spark, sf_dir)
    h = R.run_history(cr, 20)
    return h.select("integration_id", "rank", "id", "status", ts_text("started_at").alias("started_at"))


SQL_RUN_HISTORY = """
SELECT * FROM (
  SELECT user_id AS integration_id,
         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank, event_id AS id,
         CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'partial' ELSE 'success' END
           AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at
  FROM events WHERE user_id % 2 = 0) WHERE rank <= 20
"""


def q_missing_rows(spark, sf_dir):
    """J4 orders missing from the line-item side (copy of missing rows)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.missing_rows(o, li, "o_orderkey")


SQL_MISSING_ROWS = """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders o
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
"""


def q_status_counts(spark, sf_dir):
    r = control.runs(spark, sf_dir)
    return R.status_counts(r, "status", ["success", "partial", "failed"])


SQL_STATUS_COUNTS = """
SELECT COUNT(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS success_count,
       COUNT(*) FILTER (WHERE event_type = 'signup') AS partial_count,
       COUNT(*) FILTER (WHERE event_type = 'error') AS failed_count, COUNT(*) AS total_count
FROM events
"""

# ------------------------------------------------------------ L1-L9 bounds


def q_bounded_query(spark, sf_dir):
    """L1 first 500 orders by price desc, with the truncated flag."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", r2("o_totalprice").alias("o_totalprice"))
    return Q.bounded(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


SQL_BOUNDED = """
SELECT o_orderkey, o_custkey, ROUND(o_totalprice, 2) AS o_totalprice,
       (SELECT COUNT(*) FROM orders) > 500 AS truncated
FROM orders ORDER BY ROUND(o_totalprice, 2) DESC, o_orderkey LIMIT 500
"""


def q_size_budget(spark, sf_dir):
    """L2 + L4 newest orders, cut to a 4000-character JSON budget."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return Q.size_budget(o, [F.col("o_orderkey").desc()])


SQL_SIZE_BUDGET = """
WITH t AS (SELECT o_orderkey, o_orderstatus, o_orderpriority,
                  SUM(length(to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus,
                                      'o_orderpriority': o_orderpriority})) + 2)
                    OVER (ORDER BY o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS run
           FROM (SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 1000))
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM t WHERE run <= 4000
"""


def q_page_2(spark, sf_dir):
    """L5 page 2 of 25 line items of the largest extended price."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r2("l_extendedprice").alias("price"))
    return Q.page(li, [F.col("price").desc(), "l_orderkey", "l_linenumber"], 2, 25)


SQL_PAGE_2 = """
SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice, 2) AS price FROM lineitem
ORDER BY price DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 25
"""


def q_rows_as_json(spark, sf_dir):
    """L9 every nation row as one JSON object."""
    n = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return Q.rows_as_json(n)


SQL_ROWS_AS_JSON = """
SELECT to_json({'s_suppkey': s_suppkey, 's_name': s_name, 's_nationkey': s_nationkey})::VARCHAR AS row_json
FROM supplier
"""

def q_page_last(spark, sf_dir):
    """L5 the last page of all line items by price, in pages of 200: the ranges
    that hold it are found by their sizes."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r2("l_extendedprice").alias("price"))
    last = (li.count() - 1) // 200 + 1
    return Q.page(li, [F.col("price").desc(), "l_orderkey", "l_linenumber"], last, 200)


SQL_PAGE_LAST = """
SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice, 2) AS price FROM lineitem
ORDER BY price DESC, l_orderkey, l_linenumber
LIMIT 200 OFFSET (SELECT (COUNT(*) - 1) // 200 * 200 FROM lineitem)
"""


QUERIES = {
    "page_last": (q_page_last, SQL_PAGE_LAST),
    "jobs_feed": (q_jobs_feed, SQL_JOBS_FEED),
    "jobs_total": (q_jobs_total, SQL_JOBS_TOTAL),
    "daily_stats": (q_daily_stats, SQL_DAILY_STATS),
    "activity_grid": (q_activity_grid, SQL_ACTIVITY_GRID),
    "totals": (q_totals, SQL_TOTALS),
    "audit_log_page": (q_audit_log_page, SQL_AUDIT_LOG_PAGE),
    "collections_summary": (q_collections_summary, SQL_COLLECTIONS),
    "tenant_members": (q_tenant_members, SQL_TENANT_MEMBERS),
    "member_list": (q_member_list, SQL_MEMBER_LIST),
    "run_history": (q_run_history, SQL_RUN_HISTORY),
    "missing_rows": (q_missing_rows, SQL_MISSING_ROWS),
    "status_counts": (q_status_counts, SQL_STATUS_COUNTS),
    "bounded_query": (q_bounded_query, SQL_BOUNDED),
    "size_budget": (q_size_budget, SQL_SIZE_BUDGET),
    "page_2": (q_page_2, SQL_PAGE_2),
    "rows_as_json": (q_rows_as_json, SQL_ROWS_AS_JSON),
}
