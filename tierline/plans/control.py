"""Control frames derived from the driver tables by fixed formulas (the same
formulas appear in the oracle SQL).  They grow with the tables they come from.

* tenants      <- region      (``t{r_regionkey}``)
* users        <- customer    (one user per customer)
* memberships  <- customer    (tenant of the customer's nation's region;
                               role by ``c_custkey % 5``; revoked when the
                               balance is negative)
* connectors   <- events.user_id even, transforms <- events.user_id odd
* runs         <- events      (one run per event; ``error`` = failed)
* audit log    <- events
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.plans.common import table

# Roles in privilege order.
ROLES = ["owner", "admin", "engineer", "analyst", "viewer"]
CONNECTOR_TYPES = ["webhook", "csv", "api"]
TARGET_LAYERS = ["silver", "gold", "silver"]


def _pick(values, idx_col):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (idx_col % len(values)).cast("int") + 1)


def tenants(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.select(F.concat(F.lit("t"), F.col("r_regionkey").cast("string")).alias("id"),
                    F.regexp_replace(F.lower("r_name"), "[^a-z0-9]", "_").alias("slug"),
                    F.col("r_name").alias("name"))


def users(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"),
                    F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
                    F.col("c_name").alias("display_name"))


def memberships(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)   # nation: 25 rows by definition
    return j.select(F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("tenant_id"),
                    F.col("c_custkey").alias("user_id"),
                    _pick(ROLES, F.col("c_custkey")).alias("role"),
                    F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01 00:00:00")).alias("revoked_at"))


def runs(spark, sf_dir):
    """One run per event: connector runs for even users, transform runs for
    odd users; tenant ``t{user_id % 5}``."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 2 == 0, "connector").otherwise("transform")
    n_in = F.floor(F.col("value")).cast("long")
    status = F.when(F.col("event_type") == "error", "failed") \
        .when(F.col("event_type") == "signup", "partial").otherwise("success")
    return e.select(
        F.col("event_id").alias("id"), kind.alias("kind"),
        F.col("user_id").alias("job_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        status.alias("status"), F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("INTERVAL 1 SECOND")).alias("completed_at"),
        n_in.alias("records_in"),
        F.when(status == "failed", F.lit(0)).when(status == "partial", (n_in / 2).cast("long"))
        .otherwise(n_in).alias("records_out"),
        F.col("event_type"))


def connectors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id").filter(F.col("user_id") % 2 == 0).distinct()
    return e.select(F.col("user_id").alias("id"),
                    F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
                    F.concat(F.lit("conn_"), F.col("user_id").cast("string")).alias("name"),
                    _pick(CONNECTOR_TYPES, F.col("user_id")).alias("connector_type"),
                    F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("collection"))


def transforms(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id").filter(F.col("user_id") % 2 == 1).distinct()
    return e.select(F.col("user_id").alias("id"),
                    F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
                    F.concat(F.lit("tf_"), F.col("user_id").cast("string")).alias("name"),
                    _pick(TARGET_LAYERS, F.col("user_id")).alias("target_layer"),
                    F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("collection"))


def catalogue_entities(spark, sf_dir):
    """One entity per part; layer by ``p_size % 3``; collection = brand."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"),
                    F.lit("t0").alias("tenant_id"),
                    F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"),
                    _pick(["bronze", "silver", "gold"], F.col("p_size")).alias("layer"),
                    F.col("p_brand").alias("collection"),
                    F.col("p_type").alias("description"))
