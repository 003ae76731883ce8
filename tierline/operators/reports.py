"""Operations reports (O1-O9) with their set operations (U1, U2), joins
(J1-J3) and aggregates (A2-A5, A9).

Every report is grouped aggregation with partial (map-side) combine; the
joins are on dimension keys (run -> owner).  Totals pre-aggregate each branch
before the join (the reference fans out connector x transform runs, Q7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierline.operators import query as Q
from tierline.operators.joins import lookup_join

JOB_COLUMNS = ["id", "job_type", "job_name", "sub_type", "status", "started_at", "completed_at",
               "records_in", "records_out", "records_rejected", "error_detail"]


def jobs_union(connector_runs: DataFrame, connectors: DataFrame, transform_runs: DataFrame,
               transforms: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """U1 + J1: connector runs and transform runs in one shape."""
    c = connectors if tenant_id is None else connectors.filter(F.col("tenant_id") == tenant_id)
    t = transforms if tenant_id is None else transforms.filter(F.col("tenant_id") == tenant_id)
    # run -> owner lookups: broadcast when the owner table is small
    cr = lookup_join(connector_runs, c.select(F.col("id").alias("integration_id"), F.col("name").alias("job_name"),
                                              F.col("connector_type").alias("sub_type"), "tenant_id"),
                     "integration_id")
    cr = cr.select("id", F.lit("connector").alias("job_type"), "job_name", "sub_type", "status",
                   "started_at", "completed_at", "records_in", "records_out", "records_rejected",
                   F.col("error_detail").cast("string").alias("error_detail"), "tenant_id")
    tr = lookup_join(transform_runs, t.select(F.col("id").alias("transform_id"), F.col("name").alias("job_name"),
                                              F.col("target_layer").alias("sub_type"), "tenant_id"),
                     "transform_id")
    tr = tr.select("id", F.lit("transform").alias("job_type"), "job_name", "sub_type", "status",
                   "started_at", "completed_at",
                   F.coalesce("rows_produced", F.lit(0)).alias("records_in"),
                   F.coalesce("rows_produced", F.lit(0)).alias("records_out"),
                   F.lit(0).cast("long").alias("records_rejected"),
                   F.lit(None).cast("string").alias("error_detail"), "tenant_id")
    return cr.unionByName(tr)


def jobs_feed(jobs: DataFrame, page_no: int = 1, page_size: int = 50) -> DataFrame:
    """O1 newest first, one page (L5); ties broken by id for a stable page."""
    return Q.page(jobs, [F.col("started_at").desc(), F.col("job_type"), F.col("id")], page_no, page_size)


def daily_stats(jobs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """O2 per day and job type for the last ``days`` days before
    ``as_of``: total, success, failed, partial (A2, E11, E12).  ``failed``
    replaces the reference's always-zero ``error`` (Q6)."""
    since = F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz")
    return (jobs.filter(F.col("started_at") >= since)
            .groupBy(F.to_date("started_at").alias("day"), "job_type")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).alias("success"),
                 F.count_if(F.col("status") == "failed").alias("failed"),
                 F.count_if(F.col("status") == "partial").alias("partial")))


def totals(tenants: DataFrame, connectors: DataFrame, connector_runs: DataFrame,
           transforms: DataFrame, transform_runs: DataFrame) -> DataFrame:
    """O3 per tenant: connectors, transforms, connector runs, transform runs.
    Each branch is aggregated to one row per tenant first (J3 without the
    fan-out)."""
    def per_tenant(owner, runs, run_key, prefix):
        n_owner = owner.groupBy("tenant_id").agg(F.count_distinct("id").alias(f"total_{prefix}s"))
        # runs counted per owner first (map-side combine): the join then sees
        # one row per owner however many runs a single owner has
        per_owner = runs.groupBy(run_key).agg(F.count("id").alias("_n"))
        n_runs = (per_owner.join(owner.select(F.col("id").alias(run_key), "tenant_id"), run_key)
                  .groupBy("tenant_id").agg(F.sum("_n").alias(f"total_{prefix}_runs")))
        return n_owner.join(n_runs, "tenant_id", "full_outer")
    c = per_tenant(connectors, connector_runs, "integration_id", "connector")
    t = per_tenant(transforms, transform_runs, "transform_id", "transform")
    out = tenants.select(F.col("id").alias("tenant_id")).join(c, "tenant_id", "left").join(t, "tenant_id", "left")
    return out.select("tenant_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
                                     ["total_connectors", "total_transforms",
                                      "total_connector_runs", "total_transform_runs"]])


def activity_grid(daily: DataFrame, start: str, end: str, series: list[str]) -> DataFrame:
    """O5 zero-filled daily grid: every day x series, missing counts 0, plus
    the stacked total and its maximum.  The grid is days x series (a date
    range, not data-sized), joined to the already aggregated counts."""
    days = daily.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    grid = days.select("day", F.explode(F.array(*[F.lit(s) for s in series])).alias("job_type"))
    filled = grid.join(daily.select("day", "job_type", "total"), ["day", "job_type"], "left") \
        .withColumn("total", F.coalesce("total", F.lit(0)))
    wide = filled.groupBy("day").pivot("job_type", series).agg(F.first("total"))
    stack = sum((F.col(s) for s in series), F.lit(0))
    return wide.withColumn("stacked", stack).withColumn(
        "max_stacked", F.max("stacked").over(Window.partitionBy(F.lit(1))))


def collections_summary(entities: DataFrame, transforms: DataFrame, connectors: DataFrame) -> DataFrame:
    """O6 U2 + A3: per collection label, items of each kind."""
    u = (entities.select("collection", F.lit("entity").alias("kind"))
         .unionByName(transforms.select("collection", F.lit("transform").alias("kind")))
         .unionByName(connectors.select("collection", F.lit("connector").alias("kind"))))
    return (u.filter(F.col("collection").isNotNull()).groupBy("collection")
            .agg(F.count_if(F.col("kind") == "entity").alias("entity_count"),
                 F.count_if(F.col("kind") == "transform").alias("transform_count"),
                 F.count_if(F.col("kind") == "connector").alias("connector_count")))


def tenant_members(tenants: DataFrame, memberships: DataFrame) -> DataFrame:
    """Tenant left join memberships, active and total counts.  The
    membership side is aggregated per tenant before the join."""
    m = memberships.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_if(F.col("revoked_at").isNull()).alias("active_count"))
    j = tenants.select(F.col("id").alias("tenant_id"), "slug", "name").join(m, "tenant_id", "left")
    return j.select("tenant_id", "slug", "name", F.coalesce("member_count", F.lit(0)).alias("member_count"),
                    F.coalesce("active_count", F.lit(0)).alias("active_count"))


def member_list(memberships: DataFrame, users: DataFrame, tenant_id: str) -> DataFrame:
    """Members of a tenant with their account, sorted by e-mail."""
    m = memberships.filter(F.col("tenant_id") == tenant_id)
    return m.join(users, m.user_id == users.id).select(
        "user_id", "email", "display_name", "role", "revoked_at",
        F.col("revoked_at").isNull().alias("active")).orderBy("email", "user_id")


def run_history(connector_runs: DataFrame, k: int = 20) -> DataFrame:
    """O9 newest ``k`` runs of every connector (L6 per group, salted)."""
    return Q.top_k_per_group(connector_runs, ["integration_id"],
                             [F.col("started_at").desc(), F.col("id").desc()], k, salt_col="id")


def status_counts(df: DataFrame, col: str, values: list[str]) -> DataFrame:
    """A9 one-row counts per value of a status / layer column (stat cards)."""
    return df.agg(*[F.count_if(F.col(col) == v).alias(f"{v}_count") for v in values],
                  F.count(F.lit(1)).alias("total_count"))
