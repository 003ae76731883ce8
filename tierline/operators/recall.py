"""Ranked recall of text notes (M1-M5).

Candidates per tenant are the ``limit`` best notes by stored score (L8; 100 by
default, as in the data model).  They travel as one array per tenant, joined to
the tenant's queries; adaptive execution broadcasts it by its size in bytes or
splits a tenant with very many queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.functions.text import keywords
from tierline.operators.query import top_k_per_group

# Fixed values of the scoring rules.
CANDIDATES = 100
MAX_INJECTED = 5
HIT_WEIGHT = 0.5
BOOST_FACTOR = 1.2
MAX_SCORE = 2.0
DECAY_FACTOR = 0.95
PRUNE_SCORE = 0.1
PRUNE_DAYS = 90


def base_score(c="relevance_score"):
    """``float(score or 1.0)``: null or zero counts as 1.0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull() | (col == 0), F.lit(1.0)).otherwise(col.cast("double"))


def candidates(memories: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """L8 best ``limit`` notes per tenant by score desc, last use desc (id as
    the final tie-break); ``cand_rank`` keeps that order."""
    top = top_k_per_group(memories, ["tenant_id"],
                          [F.col("relevance_score").desc_nulls_last(), F.col("last_used_at").desc_nulls_last(),
                           F.col("id")], limit, salt_col="id")
    return top.withColumnRenamed("rank", "cand_rank")


def recall(queries: DataFrame, memories: DataFrame, k: int = MAX_INJECTED, limit: int | None = CANDIDATES) -> DataFrame:
    """M1-M3 for every query row (``query_id, tenant_id, text``): the top
    ``k`` notes by score = base x (1 + 0.5 x hits), hit = a keyword contained
    in the lower-cased summary (duplicates count); ties keep candidate order
    (a stable sort).  Without keywords the score is the base score.

    A tenant's candidates (at most ``limit``, the caller's bound) are one array
    beside each of its queries, and the ranking is an array expression in the
    query's row: queries are not shuffled and no query x note rows exist.
    ``limit=None`` ranks all notes (``recall_all``, without ``cand_rank``).
    """
    if limit is None:
        return recall_all(queries, memories, k)
    notes = (candidates(memories, limit)
             .groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct(
                 "cand_rank", F.col("id").alias("memory_id"), base_score().alias("base"),
                 F.lower(F.coalesce(F.col("summary"), F.lit(""))).alias("low")))).alias("_notes")))
    q = queries.select("query_id", "tenant_id", keywords("text").alias("_kw")).join(notes, "tenant_id")

    def scored(note):
        hits = F.size(F.filter("_kw", lambda w: note["low"].contains(w)))
        score = F.when(F.size("_kw") == 0, note["base"]).otherwise(note["base"] * (1 + hits * HIT_WEIGHT))
        return F.struct((-score).alias("down"), note["cand_rank"].alias("cand_rank"), note["memory_id"].alias("memory_id"), hits.alias("hits"))

    best = F.slice(F.array_sort(F.transform("_notes", scored)), 1, k)
    return (q.select("query_id", "tenant_id", F.posexplode(best).alias("_i", "_n"))
            .select("query_id", "tenant_id", "_n.memory_id", "_n.cand_rank", "_n.hits", (-F.col("_n.down")).alias("score"),
                    (F.col("_i") + 1).alias("rank")))


#: Letters of a piece, the shortest keyword's length.
PIECE = 4


def _pieces(text) -> F.Column:
    """Distinct runs of ``PIECE`` letters that a text holds."""
    at = F.sequence(F.lit(1), F.length(text) - (PIECE - 1))
    cut = F.transform(at, lambda i: F.substring(text, i, F.lit(PIECE)))
    return F.when(F.length(text) >= PIECE, F.array_distinct(F.filter(cut, lambda x: x.rlike(f"^[a-z]{{{PIECE}}}$"))))


def recall_all(queries: DataFrame, memories: DataFrame, k: int = MAX_INJECTED) -> DataFrame:
    """M3 over all notes of a tenant, with the scores and ties of ``recall``.

    * Inverted lists by tenant and piece of four letters.  A keyword can stand
      only in notes on all lists of its pieces; the shortest one is read and
      its notes are looked at (each distinct keyword of a tenant once).
    * Score bounds: ``k`` notes of a keyword's list score at least the k-th
      largest base there times what that keyword alone gives, and ``k`` notes
      of the tenant at least its k-th largest base.  A note whose base does
      not reach the larger of these even with all keywords is left out before
      queries meet notes; lists are cut there.
    * Notes without a keyword compete by the best ``k`` bases of the tenant.
    """
    notes = memories.select(
        "tenant_id", F.col("id").alias("memory_id"), base_score().alias("base"), F.lower(F.coalesce(F.col("summary"), F.lit(""))).alias("low"),
        F.struct(F.col("relevance_score").isNull().alias("a"), (-F.col("relevance_score")).alias("b"), F.col("last_used_at").isNull().alias("c"),
                 (-F.unix_micros(F.col("last_used_at").cast("timestamp"))).alias("d"), F.col("id").alias("e")).alias("place"))
    asked = queries.select("query_id", "tenant_id", keywords("text").alias("_kw")).withColumn("_m", F.size("_kw"))
    used = (asked.select("query_id", "tenant_id", "_m", F.explode("_kw").alias("word"))
            .groupBy("query_id", "tenant_id", "_m", "word").agg(F.count(F.lit(1)).alias("times")))
    words = used.select("tenant_id", "word").distinct()

    lists = notes.select("tenant_id", "memory_id", F.explode(_pieces(F.col("low"))).alias("piece"))
    wanted = words.select("tenant_id", "word", F.explode(_pieces(F.col("word"))).alias("piece"))
    sizes = lists.groupBy("tenant_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    # a word with a piece on no list stands in no note
    probe = (wanted.join(sizes, ["tenant_id", "piece"], "left").groupBy("tenant_id", "word")
             .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("p"))
             .where("p.n > 0").select("tenant_id", "word", F.col("p.piece").alias("piece")))
    found = (probe.join(lists, ["tenant_id", "piece"]).join(notes, ["tenant_id", "memory_id"])
             .where(F.col("low").contains(F.col("word"))).select("tenant_id", "word", "memory_id", "base", "place"))

    best = top_k_per_group(found.select("tenant_id", "word", "memory_id", "base"), ["tenant_id", "word"],
                           [F.col("base").desc(), F.col("memory_id")], k, salt_col="memory_id")
    per_word = best.where(F.col("rank") == k).select("tenant_id", "word", F.col("base").alias("kth"))
    first = top_k_per_group(notes.drop("low"), ["tenant_id"], [F.col("base").desc(), F.col("place")], k, salt_col="memory_id")
    per_tenant = first.where(F.col("rank") == k).select("tenant_id", F.col("base").alias("least"))
    bound = (used.join(per_word, ["tenant_id", "word"], "left").groupBy("query_id", "tenant_id", "_m")
             .agg(F.max(F.col("kth") * (1 + F.col("times") * HIT_WEIGHT)).alias("kth"))
             .join(per_tenant, "tenant_id", "left")
             # a little less than the bound: it only has to be safe
             .select("query_id", "tenant_id", (F.greatest(F.coalesce("kth", F.lit(0.0)), F.coalesce("least", F.lit(0.0)))
                                               / (1 + F.col("_m") * HIT_WEIGHT) * (1 - 1e-9)).alias("need")))
    hits = (used.drop("_m").join(bound, ["query_id", "tenant_id"]).join(found, ["tenant_id", "word"]).where("base >= need")
            .select("query_id", "tenant_id", "memory_id", "base", "place", "times"))
    plain = asked.select("query_id", "tenant_id").join(first.drop("rank"), "tenant_id").withColumn("times", F.lit(0).cast("long"))
    scored = (hits.unionByName(plain.select(*hits.columns)).groupBy("query_id", "tenant_id", "memory_id")
              .agg(F.sum("times").cast("int").alias("hits"), F.first("base").alias("base"), F.first("place").alias("place"))
              .withColumn("score", F.col("base") * (1 + F.col("hits") * HIT_WEIGHT)))
    top = top_k_per_group(scored, ["query_id", "tenant_id"], [F.col("score").desc(), F.col("place")], k, salt_col="memory_id")
    return top.select("query_id", "tenant_id", "memory_id", "hits", "score", "rank")


def boost(memories: DataFrame, recalled: DataFrame, now: str) -> DataFrame:
    """M4 every recall of a note multiplies its score by 1.2 (capped at 2.0)
    and adds one use.  A batch applies all recalls of the batch at once:
    score x 1.2^n, capped."""
    n = recalled.groupBy("memory_id").agg(F.count(F.lit(1)).alias("_n"))
    j = memories.join(n, memories.id == n.memory_id, "left").drop("memory_id")
    hit = F.col("_n").isNotNull()
    new_score = F.least(F.lit(MAX_SCORE), base_score() * F.pow(F.lit(BOOST_FACTOR), F.col("_n")))
    return j.select(*[F.when(hit, new_score).otherwise(F.col(c)).alias(c) if c == "relevance_score"
                      else F.when(hit, F.coalesce(F.col(c), F.lit(0)) + F.col("_n")).otherwise(F.col(c)).alias(c)
                      if c == "use_count"
                      else F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c)
                      if c == "last_used_at" else F.col(c) for c in memories.columns])


def decay(memories: DataFrame) -> DataFrame:
    """M5 score x 0.95, never below 0."""
    return memories.withColumn("relevance_score", F.greatest(F.lit(0.0), F.col("relevance_score") * DECAY_FACTOR))


def prune(memories: DataFrame, now: str) -> DataFrame:
    """M5 drop notes scoring below 0.1 or unused for more than 90 days."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {PRUNE_DAYS} DAYS")
    gone = (F.col("relevance_score") < PRUNE_SCORE) | (F.col("last_used_at") < cutoff)
    return memories.filter(~F.coalesce(gone, F.lit(False)))
