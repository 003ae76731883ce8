"""Lineage and change propagation (R1-R8) over frames of transforms and
catalogue entities.

Table references are pulled out of the stored SQL text with regular
expressions per row (R1); resolution to entities (R2) is an equi join on
(tenant, name) plus a per-transform layer preference; graph walks (R4, R7) are
frontier loops of joins with an anti join against what was already reached,
with the frontier cut from its lineage by a reliable checkpoint each round.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.operators.joins import lookup_join
from tierline.session import cut_lineage

LAYER_ORDER = ["bronze", "silver", "gold"]
# Fixed patterns: target and source table references in stored SQL.
TARGET_RE = (r"(?i)\b(?:CREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"
             r"|INSERT\s+(?:OR\s+\w+\s+)?INTO\s+)(?:\w+\.)?(\w+)")
FROM_RE = r"(?i)\bFROM\s+(?:\w+\.)?(\w+)"
JOIN_RE = r"(?i)\bJOIN\s+(?:\w+\.)?(\w+)"
MAX_CASCADE_DEPTH = 5
DEBOUNCE_SECONDS = 30


def table_refs(transforms: DataFrame, sql_col: str = "transform_sql") -> DataFrame:
    """R1 adds ``target_name`` (first CREATE/INSERT target) and ``source_names``
    (all FROM names, then all JOIN names, de-duplicated in order)."""
    sql = F.coalesce(F.col(sql_col), F.lit(""))
    tgt = F.regexp_extract(sql, TARGET_RE, 1)
    srcs = F.array_distinct(F.concat(F.regexp_extract_all(sql, F.lit(FROM_RE), 1),
                                     F.regexp_extract_all(sql, F.lit(JOIN_RE), 1)))
    return transforms.withColumn("target_name", F.when(tgt != "", tgt)).withColumn("source_names", srcs)


def _target_pref(target_layer: Column) -> Column:
    others = [F.when(target_layer != F.lit(ly), F.lit(ly)) for ly in LAYER_ORDER]
    return F.filter(F.concat(F.array(target_layer), F.array(*others)), lambda x: x.isNotNull())


def _source_pref(source_layer: Column, target_layer: Column) -> Column:
    """Layers below the target nearest first, then the declared source layer,
    then every layer except the target; first occurrence kept."""
    order = F.array(*[F.lit(x) for x in LAYER_ORDER])
    src_idx = F.coalesce(F.array_position(order, source_layer) - 1, F.lit(0))
    tgt_idx = F.coalesce(F.array_position(order, target_layer) - 1, F.lit(len(LAYER_ORDER)))
    span = F.when(tgt_idx > src_idx, F.slice(order, (src_idx + 1).cast("int"), (tgt_idx - src_idx).cast("int"))) \
        .otherwise(F.array().cast("array<string>"))
    rest = F.filter(order, lambda x: x != target_layer)
    return F.array_distinct(F.concat(F.reverse(span), F.array(source_layer), rest))


def resolve(transforms: DataFrame, entities: DataFrame) -> DataFrame:
    """R2 per transform: ``target_id`` and ordered ``source_ids``.

    ``transforms``: id, tenant_id, source_layer, target_layer, transform_sql
    (optional target_entity_id / source_entity_id);
    ``entities``: id, tenant_id, name, layer.
    """
    t = table_refs(transforms)
    if "target_entity_id" not in t.columns:
        t = t.withColumn("target_entity_id", F.lit(None).cast("string"))
    if "source_entity_id" not in t.columns:
        t = t.withColumn("source_entity_id", F.lit(None).cast("string"))
    t = t.withColumn("source_layer", F.coalesce("source_layer", F.lit("bronze"))) \
        .withColumn("target_layer", F.coalesce("target_layer", F.lit("silver")))
    ent = entities.select(F.col("id").alias("eid"), "tenant_id", F.col("name").alias("ename"),
                          F.col("layer").alias("elayer"))
    # singleton fallback: the only entity of a layer
    single = (entities.groupBy("tenant_id", "layer")
              .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_only"))
              .filter(F.col("_n") == 1).drop("_n"))

    # target
    tc = t.select(F.col("id").alias("tid"), "tenant_id", "target_name",
                  _target_pref(F.col("target_layer")).alias("_pref"))
    tm = tc.join(ent, (tc.tenant_id == ent.tenant_id) & (tc.target_name == ent.ename)) \
        .select("tid", F.array_position("_pref", F.col("elayer")).alias("_r"), "eid")
    tm = tm.filter(F.col("_r") > 0).groupBy("tid").agg(F.min_by("eid", "_r").alias("_tgt"))
    # sources: first layer in preference order per name, ids de-duplicated in name order
    sc = t.select(F.col("id").alias("tid"), "tenant_id",
                  _source_pref(F.col("source_layer"), F.col("target_layer")).alias("_pref"),
                  F.posexplode("source_names").alias("_pos", "_name"))
    sm = sc.join(ent, (sc.tenant_id == ent.tenant_id) & (sc._name == ent.ename)) \
        .select("tid", "_pos", F.array_position("_pref", F.col("elayer")).alias("_r"), "eid")
    sm = sm.filter(F.col("_r") > 0).groupBy("tid", "_pos").agg(F.min_by("eid", "_r").alias("eid"))
    sm = sm.groupBy("tid", "eid").agg(F.min("_pos").alias("_pos"))
    srcs = sm.groupBy("tid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "eid"))), lambda s: s["eid"]).alias("_srcs"))

    out = t.join(tm, t.id == tm.tid, "left").drop("tid").join(srcs, t.id == srcs.tid, "left").drop("tid")
    # singletons: at most tenants x 3 rows, broadcast after a size check
    st = single.select(F.col("tenant_id").alias("_st"), F.col("layer").alias("_sl"), F.col("_only").alias("_tonly"))
    out = lookup_join(out, st, (F.col("tenant_id") == F.col("_st")) & (F.col("target_layer") == F.col("_sl")),
                      "left").drop("_st", "_sl")
    ss = single.select(F.col("tenant_id").alias("_st"), F.col("layer").alias("_sl"), F.col("_only").alias("_sonly"))
    out = lookup_join(out, ss, (F.col("tenant_id") == F.col("_st")) & (F.col("source_layer") == F.col("_sl")),
                      "left").drop("_st", "_sl")
    target = F.coalesce(F.col("target_entity_id"), F.col("_tgt"), F.col("_tonly"))
    sources = F.when(F.col("source_entity_id").isNotNull(), F.array(F.col("source_entity_id"))) \
        .when(F.size(F.coalesce("_srcs", F.array())) > 0, F.col("_srcs")) \
        .when(F.col("_sonly").isNotNull(), F.array(F.col("_sonly"))) \
        .otherwise(F.array().cast("array<string>"))
    return out.withColumn("target_id", target).withColumn("source_ids", sources) \
        .drop("_tgt", "_srcs", "_tonly", "_sonly")


def edges(resolved: DataFrame) -> DataFrame:
    """R3 one edge per (source, target); a transform with no source or no
    target keeps one edge with null ends."""
    for c in ("name", "status"):
        if c not in resolved.columns:
            resolved = resolved.withColumn(c, F.lit(None).cast("string"))
    full = resolved.filter(F.col("target_id").isNotNull() & (F.size("source_ids") > 0))
    e1 = full.select(F.col("id").alias("transform_id"), "name", "status", "source_layer", "target_layer",
                     F.explode("source_ids").alias("source_entity_id"), F.col("target_id").alias("target_entity_id"))
    e1 = e1.withColumn("edge_id", F.concat_ws("_", "transform_id", "source_entity_id"))
    part = resolved.filter(F.col("target_id").isNull() | (F.size("source_ids") == 0))
    e2 = part.select(F.col("id").alias("transform_id"), "name", "status", "source_layer", "target_layer",
                     F.try_element_at(F.col("source_ids"), F.lit(1)).alias("source_entity_id"),
                     F.col("target_id").alias("target_entity_id"),
                     F.col("id").alias("edge_id"))
    return e1.unionByName(e2)


def upstream(edge_df: DataFrame, roots: DataFrame) -> DataFrame:
    """R4 all ancestors of each root: (root, node, depth = shortest hops).

    Frontier join + anti join with the reached pairs until the frontier is
    empty; cycles end because reached pairs never re-enter.  Each round writes
    its frontier only; the reached pairs are the union of the frontiers."""
    e = cut_lineage(edge_df.filter(F.col("source_entity_id").isNotNull() & F.col("target_entity_id").isNotNull())
                    .select(F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("tgt")).distinct())
    frontier = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    reached = frontier
    while True:
        step = frontier.join(e, frontier.node == e.tgt).select("root", F.col("src").alias("node"),
                                                               (F.col("depth") + 1).alias("depth"))
        step = step.join(reached.select("root", "node"), ["root", "node"], "left_anti") \
            .groupBy("root", "node").agg(F.min("depth").alias("depth"))
        frontier = cut_lineage(step)
        if frontier.limit(1).count() == 0:
            return reached.filter(F.col("depth") > 0)
        reached = reached.unionByName(frontier)


def search_filter(edge_df: DataFrame, nodes: DataFrame, q: str = "", status: str | None = None) -> DataFrame:
    """R5 edges whose status matches and whose both ends are visible nodes
    (name contains ``q``, case-insensitive)."""
    vis = nodes.filter(F.lower("name").contains(q.lower())) if q else nodes
    vis = vis.select("id")
    e = edge_df.filter(F.col("status") == status) if status else edge_df
    e = e.join(vis.withColumnRenamed("id", "source_entity_id"), "source_entity_id", "left_semi")
    return e.join(vis.withColumnRenamed("id", "target_entity_id"), "target_entity_id", "left_semi")


def watchers(transforms: DataFrame, changed: DataFrame) -> DataFrame:
    """R6 approved ``on_change`` transforms whose watch list holds a changed
    entity: (entity_id, transform_id)."""
    t = transforms.filter((F.col("trigger_mode") == "on_change") & (F.col("status") == "approved"))
    w = t.select(F.col("id").alias("transform_id"), "tenant_id",
                 F.explode(F.from_json(F.coalesce("watch_entities", F.lit("[]")), "array<string>"))
                 .alias("entity_id"))
    return w.join(changed.select(F.col("id").alias("entity_id"), "tenant_id"), ["entity_id", "tenant_id"])


def cascade_plan(transforms: DataFrame, resolved: DataFrame, changed: DataFrame,
                 max_depth: int | None = MAX_CASCADE_DEPTH) -> DataFrame:
    """R7 changed entities -> watchers (depth 0) -> their targets -> watchers
    (depth 1) ...; every transform planned once, at its first depth.

    ``max_depth`` is the caller's bound (default: the data model's); None goes
    on until nothing new is reached.  ``cascade_cut`` tells what a bound left
    out."""
    targets = resolved.select(F.col("id").alias("transform_id"), F.col("target_id").alias("id"), "tenant_id")
    planned = None
    frontier = changed.select("id", "tenant_id")
    for depth in (range(max_depth) if max_depth is not None else itertools.count()):
        w = watchers(transforms, frontier).select("transform_id", "tenant_id").distinct()
        if planned is not None:
            w = w.join(planned.select("transform_id"), "transform_id", "left_anti")
        w = cut_lineage(w.withColumn("depth", F.lit(depth)))
        if w.limit(1).count() == 0:
            break
        planned = w if planned is None else planned.unionByName(w)
        frontier = w.join(targets, ["transform_id", "tenant_id"]).filter(F.col("id").isNotNull()) \
            .select("id", "tenant_id").distinct()
    if planned is None:
        return transforms.sparkSession.createDataFrame([], "transform_id string, tenant_id string, depth int")
    return planned


def cascade_cut(transforms: DataFrame, resolved: DataFrame, changed: DataFrame,
                max_depth: int = MAX_CASCADE_DEPTH) -> DataFrame:
    """The transforms (with their depths) that ``cascade_plan`` with this bound
    leaves out."""
    return cascade_plan(transforms, resolved, changed, None).filter(F.col("depth") >= max_depth)


DEBOUNCE_FOLD_LIMIT = 100_000


def debounce(events: DataFrame, key: str, ts: str, order_tie: str, seconds: int = DEBOUNCE_SECONDS,
             bucket: str = "hour", fold_limit: int = DEBOUNCE_FOLD_LIMIT) -> DataFrame:
    """R8 per key, an event fires when at least ``seconds`` passed since the
    key's last *fired* event (a lag is not enough: it depends on firing).
    ``order_tie`` must be unique per key.

    Events are cut into bursts (consecutive gap < ``seconds``); the first event
    of a burst always fires, so bursts are independent.  Gaps are computed per
    (key, hour) with the previous hour's last event carried over, so a busy key
    is spread over many window partitions.  A burst of at most ``fold_limit``
    events is folded as one sorted array; a longer one (a key with continuous
    traffic) is solved exactly without gathering it: every event points to the
    first event ``seconds`` later (``_next_fire``) and the fired chain from the
    burst start is found by pointer doubling (``_chain``).  Output: the fired
    events.
    """
    w_us = seconds * 1_000_000
    # microseconds since the epoch without a session-zone conversion
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                          F.col(ts).cast("timestamp_ntz"))
    b = events.select(key, order_tie, us.alias("_t"), F.date_trunc(bucket, F.col(ts)).alias("_b"))
    per = b.groupBy(key, "_b").agg(F.max("_t").alias("_last"))
    wb = Window.partitionBy(key).orderBy("_b")          # keys x buckets rows
    per = per.withColumn("_prev_last", F.lag("_last").over(wb))
    b = b.join(per.select(key, "_b", "_prev_last"), [key, "_b"])
    w = Window.partitionBy(key, "_b").orderBy("_t", order_tie)
    prev = F.coalesce(F.lag("_t").over(w), F.col("_prev_last"))
    b = b.withColumn("_start", (prev.isNull() | (F.col("_t") - prev >= w_us)).cast("int"))
    b = b.withColumn("_seg_local", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = b.groupBy(key, "_b").agg(F.sum("_start").alias("_ns"))
    starts = starts.withColumn("_off", F.coalesce(F.sum("_ns").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                                  F.lit(0)))
    b = b.join(starts.select(key, "_b", "_off"), [key, "_b"]) \
        .select(key, order_tie, "_t", (F.col("_seg_local") + F.col("_off")).alias("_seg"))
    sizes = b.groupBy(key, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    biggest = sizes.agg(F.max("_n")).first()[0] or 0        # one number
    b = b.join(sizes, [key, "_seg"])                       # same partitioning as the fold below
    small = b.filter(F.col("_n") <= fold_limit)
    bursts = small.groupBy(key, "_seg").agg(F.array_sort(F.collect_list(F.struct("_t", order_tie))).alias("_ev"))
    init = F.struct(F.lit(None).cast("long").alias("last"),
                    F.array().cast(f"array<{b.schema[order_tie].dataType.simpleString()}>").alias("fired"))
    fold = F.aggregate(
        "_ev", init,
        lambda acc, x: F.when(acc["last"].isNull() | (x["_t"] - acc["last"] >= w_us),
                              F.struct(x["_t"].alias("last"),
                                       F.concat(acc["fired"], F.array(x[order_tie])).alias("fired")))
        .otherwise(acc))
    fired = bursts.select(key, F.explode(fold["fired"]).alias(order_tie))
    if biggest > fold_limit:
        large = b.filter(F.col("_n") > fold_limit).select(key, F.col(order_tie).alias("_id"), "_t", "_seg")
        fired = fired.unionByName(_chain(large, key, w_us, biggest).withColumnRenamed("_id", order_tie))
    return events.join(fired, [key, order_tie], "left_semi")


def _next_fire(ev: DataFrame, key: str, w_us: int) -> DataFrame:
    """For every event, the first event of the same key and burst at least
    ``w_us`` later (null at the end of a burst).

    Events are put in ``w_us``-wide buckets; the answer lies in the next
    bucket (found by a range window over that bucket's events, which are
    copied into the current bucket's partition) or is the first event of a
    later bucket (a window over the per-bucket minimum).  Every window
    partition holds at most two buckets of one key.
    """
    q = F.floor(F.col("_t") / F.lit(w_us)).cast("long")
    ev = ev.withColumn("_q", q)
    own = ev.select(key, "_id", "_t", "_seg", F.col("_q").alias("_part"), F.lit(True).alias("_own"))
    tgt = ev.select(key, "_id", "_t", "_seg", (F.col("_q") - 1).alias("_part"), F.lit(False).alias("_own"))
    # what follows, read backwards: a running minimum instead of one pass a row
    w = Window.partitionBy(key, "_part").orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, -w_us)
    near = own.unionByName(tgt).withColumn(
        "_near", F.min(F.when(~F.col("_own"), F.struct("_t", "_id", "_seg"))).over(w)) \
        .filter(F.col("_own")).select(key, "_id", "_t", "_seg", F.col("_part").alias("_q"), "_near")
    firsts = ev.groupBy(key, "_q").agg(F.min(F.struct("_t", "_id", "_seg")).alias("_first"))
    wq = Window.partitionBy(key).orderBy(F.desc("_q")).rangeBetween(Window.unboundedPreceding, -2)
    firsts = firsts.withColumn("_later", F.min("_first").over(wq))
    j = near.join(firsts.select(key, "_q", "_later"), [key, "_q"])
    nxt = F.coalesce(F.col("_near"), F.col("_later"))
    return j.select(key, "_id", "_seg", F.when(nxt["_seg"] == F.col("_seg"), nxt["_id"]).alias("_to"))


def _chain(large: DataFrame, key: str, w_us: int, longest: int) -> DataFrame:
    """Fired events of long bursts: the chain start, nxt(start),
    nxt(nxt(start)), ...  Pointer doubling: after round i the reached set
    holds every chain member within 2^(i+1) - 1 steps and the jump table holds
    2^(i+1) steps, so ceil(log2(longest)) rounds reach the chain's end.  All
    joins are on unique (key, event) ids; each round is checkpointed."""
    jump = cut_lineage(_next_fire(large, key, w_us).select(key, "_id", "_to"))
    reached = large.groupBy(key, "_seg").agg(F.min_by("_id", F.struct("_t", "_id")).alias("_id")) \
        .select(key, "_id")
    rounds = max(1, math.ceil(math.log2(max(2, longest))))
    for _ in range(rounds):
        step = reached.join(jump, [key, "_id"]).filter(F.col("_to").isNotNull()) \
            .select(key, F.col("_to").alias("_id"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_lineage(a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._to") == F.col("b._id")),
                                  "left")
                           .select(F.col(f"a.{key}").alias(key), F.col("a._id").alias("_id"),
                                   F.col("b._to").alias("_to")))
    return reached
