"""Recall plans (M1-M5): notes from ``benchmark``, queries = user turns of
``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.operators import recall as M
from tierline.plans.common import r2, table, ts_text

NOW = "2024-06-01 00:00:00"


def memories(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    return b.select(k.alias("id"), F.concat(F.lit("t"), (k % 2).cast("string")).alias("tenant_id"),
                    F.element_at(F.array(F.lit("context"), F.lit("preference"), F.lit("routine")),
                                 (k % 3).cast("int") + 1).alias("category"),
                    F.col("text").alias("summary"),
                    F.when(k % 11 == 0, F.lit(None).cast("double"))
                    .otherwise(F.lit(0.05) + (k % 10) * 0.15).alias("relevance_score"),
                    (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(k * 3)).alias("last_used_at"),
                    (k % 4).alias("use_count"))


def queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
                    F.concat(F.lit("t"), (F.col("conv_id") % 2).cast("string")).alias("tenant_id"), "text")


def q_recall_topk(spark, sf_dir):
    r = M.recall(queries(spark, sf_dir), memories(spark, sf_dir))
    return r.select("query_id", "rank", "memory_id", "hits", F.round("score", 4).alias("score"))


_MEM_SQL = """
WITH m AS (SELECT item_id AS id, 't' || CAST(item_id % 2 AS VARCHAR) AS tenant_id, text AS summary,
                  CASE WHEN item_id % 11 = 0 THEN NULL
                       ELSE 0.05::DOUBLE + CAST(item_id % 10 AS DOUBLE) * 0.15::DOUBLE END AS relevance_score,
                  TIMESTAMP '2024-01-01' + to_days(CAST(item_id * 3 AS INTEGER)) AS last_used_at,
                  item_id % 4 AS use_count
           FROM benchmark),
c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id
                                  ORDER BY relevance_score DESC NULLS LAST, last_used_at DESC NULLS LAST, id)
                AS cand_rank FROM m QUALIFY cand_rank <= 100),
q AS (SELECT conv_id * 1000 + turn AS query_id, 't' || CAST(conv_id % 2 AS VARCHAR) AS tenant_id,
             list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'),
                         lambda w: NOT list_contains(['with', 'that', 'this', 'from', 'have', 'they', 'will',
                                                      'what', 'when', 'where', 'which', 'into', 'some', 'your',
                                                      'data', 'table'], w)) AS kw
      FROM conversations WHERE role = 'user'),
s AS (SELECT q.query_id, c.id AS memory_id, c.cand_rank,
             len(list_filter(q.kw, lambda w: contains(lower(COALESCE(c.summary, '')), w))) AS hits,
             CASE WHEN c.relevance_score IS NULL OR c.relevance_score = 0 THEN 1.0::DOUBLE ELSE c.relevance_score END
               AS base, len(q.kw) AS nkw
      FROM q JOIN c ON q.tenant_id = c.tenant_id),
r AS (SELECT query_id, memory_id, hits, CASE WHEN nkw = 0 THEN base ELSE base * (1.0::DOUBLE + CAST(hits AS DOUBLE) * 0.5::DOUBLE) END AS score,
             cand_rank FROM s)
"""
SQL_RECALL_TOPK = _MEM_SQL + """
SELECT query_id, rank, memory_id, hits, ROUND(score, 4) AS score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS rank FROM r)
WHERE rank <= 5
"""


def q_recall_all(spark, sf_dir):
    """M3 over all notes: with ``limit=None`` no note is left out beforehand."""
    r = M.recall(queries(spark, sf_dir), memories(spark, sf_dir), limit=None)
    return r.select("query_id", "rank", "memory_id", "hits", F.round("score", 4).alias("score"))


SQL_RECALL_ALL = SQL_RECALL_TOPK.replace("QUALIFY cand_rank <= 100", "")


def q_memory_boost(spark, sf_dir):
    """M4 notes after the batch recall: score x 1.2 per recall (cap 2.0),
    use count + recalls."""
    mem = memories(spark, sf_dir)
    r = M.recall(queries(spark, sf_dir), mem)
    b = M.boost(mem, r, NOW)
    return b.select("id", r2("relevance_score", 4).alias("relevance_score"), "use_count",
                    ts_text("last_used_at").alias("last_used_at"))


SQL_MEMORY_BOOST = _MEM_SQL + """
, top AS (SELECT memory_id, COUNT(*) AS n FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS rank FROM r)
  WHERE rank <= 5 GROUP BY memory_id)
SELECT m.id,
       ROUND(CASE WHEN top.n IS NULL THEN m.relevance_score
                  ELSE LEAST(2.0::DOUBLE, (CASE WHEN m.relevance_score IS NULL OR m.relevance_score = 0 THEN 1.0::DOUBLE
                                        ELSE m.relevance_score END) * POW(1.2::DOUBLE, CAST(top.n AS DOUBLE))) END, 4) AS relevance_score,
       CASE WHEN top.n IS NULL THEN m.use_count ELSE m.use_count + top.n END AS use_count,
       strftime(CASE WHEN top.n IS NULL THEN m.last_used_at ELSE TIMESTAMP '2024-06-01' END,
                '%Y-%m-%d %H:%M:%S.%f') AS last_used_at
FROM m LEFT JOIN top ON top.memory_id = m.id
"""


def q_decay_prune(spark, sf_dir):
    """M5 decay then prune at a fixed 'now'."""
    d = M.prune(M.decay(memories(spark, sf_dir)), NOW)
    return d.select("id", r2("relevance_score", 4).alias("relevance_score"))


SQL_DECAY_PRUNE = _MEM_SQL + """
SELECT id, ROUND(GREATEST(0.0::DOUBLE, relevance_score * 0.95::DOUBLE), 4) AS relevance_score FROM m
WHERE NOT COALESCE(GREATEST(0.0::DOUBLE, relevance_score * 0.95::DOUBLE) < 0.1::DOUBLE
                   OR last_used_at < TIMESTAMP '2024-06-01' - INTERVAL 90 DAY, false)
"""

QUERIES = {
    "recall_topk": (q_recall_topk, SQL_RECALL_TOPK),
    "recall_all": (q_recall_all, SQL_RECALL_ALL),
    "memory_boost": (q_memory_boost, SQL_MEMORY_BOOST),
    "decay_prune": (q_decay_prune, SQL_DECAY_PRUNE),
}
