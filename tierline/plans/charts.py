"""Chart plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.operators import charts as C
from tierline.plans.common import r2, table, ts_text


def q_bar_sum(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    g = C.group_bars(li.withColumn("flag", F.concat("l_returnflag", F.lit("/"), "l_linestatus")),
                     "flag", "l_extendedprice")
    return g.select("flag", r2("value").alias("value"))


SQL_BAR_SUM = """
SELECT l_returnflag || '/' || l_linestatus AS flag, ROUND(SUM(l_extendedprice), 2) AS value
FROM lineitem GROUP BY 1
"""


def q_bar_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return C.group_bars(o, "o_orderpriority", agg="count").withColumnRenamed("value", "n")


SQL_BAR_COUNT = "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1"


def q_hist_price(spark, sf_dir):
    h = C.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)
    return h.select("bin", r2("lo").alias("lo"), r2("hi").alias("hi"), "n")


SQL_HIST_PRICE = """
WITH s AS (SELECT MIN(l_extendedprice) AS mn, MAX(l_extendedprice) AS mx FROM lineitem),
b AS (SELECT CAST(LEAST(floor((l_extendedprice - mn) / (mx - mn) * 20) + 1, 20) AS INTEGER) AS bin, mn, mx
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL)
SELECT bin, ROUND(mn + (bin - 1) * ((mx - mn) / 20), 2) AS lo, ROUND(mn + bin * ((mx - mn) / 20), 2) AS hi,
       COUNT(*) AS n FROM b GROUP BY bin, mn, mx
"""


def q_top20(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_retailprice")
    return C.top_bars(p, "p_retailprice", "p_partkey", 20)


SQL_TOP20 = """
SELECT p_name, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20
"""


def q_column_profile(spark, sf_dir):
    return C.profile_columns(table(spark, sf_dir, "events"))


SQL_COLUMN_PROFILE = """
WITH u AS (
  SELECT col, ordinal, v FROM (
    SELECT 'event_id' AS col, 0 AS ordinal, CAST(event_id AS VARCHAR) AS v FROM events
    UNION ALL SELECT 'ts', 1, CAST(ts AS VARCHAR) FROM events
    UNION ALL SELECT 'user_id', 2, CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT 'event_type', 3, event_type FROM events
    UNION ALL SELECT 'value', 4, CAST(value AS VARCHAR) FROM events
    UNION ALL SELECT 'props', 5, props FROM events)),
g AS (SELECT col, ordinal,
             COUNT(*) FILTER (WHERE v IS NOT NULL AND v <> '') AS n,
             COUNT(*) FILTER (WHERE v IS NOT NULL AND v <> '' AND TRY_CAST(trim(v) AS DOUBLE) IS NOT NULL) AS n_num,
             COALESCE(bool_and(regexp_matches(v, '^https?://')) FILTER (WHERE v IS NOT NULL AND v <> ''), false)
               AS all_url,
             COALESCE(bool_and(starts_with(trim(v), '[') OR starts_with(trim(v), '{'))
                      FILTER (WHERE v IS NOT NULL AND v <> ''), false) AS all_json,
             COALESCE(bool_and(length(v) > 80) FILTER (WHERE v IS NOT NULL AND v <> ''), false) AS all_long,
             COALESCE(bool_and(regexp_matches(v, '\\d{4}') AND TRY_CAST(v AS TIMESTAMP) > TIMESTAMP '2000-01-01')
                      FILTER (WHERE v IS NOT NULL AND v <> ''), false) AS all_date,
             COUNT(DISTINCT v) FILTER (WHERE v IS NOT NULL AND v <> '') AS n_distinct
      FROM u GROUP BY col, ordinal)
SELECT col AS name, ordinal,
       regexp_matches(col, '^(id|.*_id|uid|uuid|guid|pk|key|hash|token|slug|url|href|link)$', 'i') OR n = 0
         OR all_url OR all_json OR all_long AS unplottable,
       n > 0 AND n_num / n >= 0.7 AS numeric,
       regexp_matches(col, '\\b(date|time|timestamp)\\b', 'i') OR regexp_matches(col, '(_at|_on|_date|_time)$', 'i')
         OR regexp_matches(col, '^(created|updated|started|ended|deleted|modified)_', 'i') OR all_date AS date_like,
       regexp_matches(col, '^(name|label|title|description|category|type|status|kind|tag|group|region|country|city)$',
                      'i') AS label,
       NOT (n_distinct = n AND n > 5) AND n_distinct >= 2 AND n_distinct <= 25 AS categorical
FROM g
"""


def q_chart_choice(spark, sf_dir):
    """P12 chart for three tables."""
    outs = []
    for name in ("events", "orders", "part"):
        outs.append(C.choose_chart(C.profile_columns(table(spark, sf_dir, name)))
                    .withColumn("table_name", F.lit(name)))
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


SQL_CHART_CHOICE = """
SELECT * FROM (VALUES
  ('events', 'time-series', 'ts', 'value', CAST(NULL AS VARCHAR)),
  ('orders', 'bar', 'o_orderkey', 'o_orderstatus', NULL),
  ('part', 'bar', 'p_partkey', 'p_brand', NULL)
) AS v(table_name, chart, x, y, y2)
"""


def q_chart_cast(spark, sf_dir):
    """P13 events with every value as text, cast for plotting by the profile."""
    e = table(spark, sf_dir, "events")
    text = e.select(*[F.col(c).cast("string").alias(c) for c in ("event_id", "ts", "event_type", "value")])
    out = C.chart_cast(text, [r.asDict() for r in C.profile_columns(text).collect()])   # one row a column
    return out.select("event_id", ts_text("ts").alias("ts"), "event_type", F.round("value", 2).alias("value"))


SQL_CHART_CAST = """
SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_type,
       ROUND(CAST(value AS DOUBLE), 2) AS value
FROM events
"""

QUERIES = {
    "chart_cast": (q_chart_cast, SQL_CHART_CAST),
    "bar_sum": (q_bar_sum, SQL_BAR_SUM),
    "bar_count": (q_bar_count, SQL_BAR_COUNT),
    "hist_price": (q_hist_price, SQL_HIST_PRICE),
    "top20": (q_top20, SQL_TOP20),
    "column_profile": (q_column_profile, SQL_COLUMN_PROFILE),
    "chart_choice": (q_chart_choice, SQL_CHART_CHOICE),
}
