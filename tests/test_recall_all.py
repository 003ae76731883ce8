"""Recall over all notes against brute force (M3)."""

import random
import re

import pytest

from tierline.functions.text import STOP_WORDS
from tierline.operators import recall as M

WORDS = ["coffee", "cof", "office", "offices", "meeting", "meet", "table", "tablecloth", "green", "évening", "evening", "x", "with", "réport"]


def brute(queries, notes, k):
    out = []
    for qid, tenant, text in queries:
        kw = [w for w in re.findall(r"[a-z]{4,}", (text or "").lower()) if w not in STOP_WORDS]
        rows = []
        for i, t, score, used, summary in notes:
            if t == tenant:
                hits = sum(w in (summary or "").lower() for w in kw)
                base = score or 1.0
                rows.append((-base * (1 + hits * 0.5), score is None, -(score or 0), used is None, -(used or 0), i, hits))
        out += [(qid, r[5], r[6], round(-r[0], 9), n) for n, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_recall_all_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    few = seed % 2                     # many equal scores, or all different
    notes = [(i, rng.choice(["a", "a", "b", "c"]), rng.choice([None, 0.0, 0.5, 1.0, 2.0]) if few else rng.random() * 2,
              rng.choice([None, 5, 6, rng.randrange(1000)]), rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12))).title()]))
             for i in range(300)]
    queries = [(i, rng.choice(["a", "b", "c", "nobody"]), rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))]))
               for i in range(60)]
    q = spark.createDataFrame(queries, "query_id long, tenant_id string, text string")
    m = spark.createDataFrame(notes, "id long, tenant_id string, relevance_score double, used long, summary string").selectExpr(
        "id", "tenant_id", "relevance_score", "cast(timestamp_seconds(used) as timestamp_ntz) AS last_used_at", "summary")
    got = M.recall(q, m, k=5, limit=None)
    assert got.columns == ["query_id", "tenant_id", "memory_id", "hits", "score", "rank"]
    assert sorted((r.query_id, r.memory_id, r.hits, round(r.score, 9), r["rank"]) for r in got.collect()) == brute(queries, notes, 5)


def test_bounds_cut_lists_before_queries_meet_notes(spark):
    """Of 4000 notes that hold the word, few can reach the top."""
    m = spark.range(4000).selectExpr("id", "concat('t', id % 1) AS tenant_id", "0.1 + id / 2000 AS relevance_score", "timestamp_ntz'2024-01-01' AS last_used_at",
                                     "concat('coffee ', id) AS summary")
    q = spark.range(50).selectExpr("id AS query_id", "concat('t', id % 1) AS tenant_id", "'coffee' AS text")
    out = M.recall_all(q, m)
    plan = out._jdf.queryExecution()
    rows = out.collect()
    assert [r.memory_id for r in sorted(rows, key=lambda r: (r.query_id, r["rank"]))] == [3999, 3998, 3997, 3996, 3995] * 50
    assert "CartesianProduct" not in plan.toString() and "BroadcastNestedLoopJoin" not in plan.toString()
