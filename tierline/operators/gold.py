"""T2 gold tables kept by deltas instead of rebuilds.

A gold table here is a group-by over a silver table: per group the number of
rows, and for named columns their sum and the number of values.  All of these
can take rows back, so the change set of a silver upsert (rows as they were,
with sign -1, and as they are now, with +1) is all that a refresh reads: it is
aggregated to one delta a group, and only the groups whose delta is not zero
are read and rewritten (by bucket).  Sums are decimals: taking back what was
added leaves nothing behind, as it would with floating point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.sources.sinks import SIGN_COL, read_table_or_none, upsert_table

#: Type of sums.
SUM = "decimal(38,6)"
ROWS, APPLIED = "n_rows", "_applied"


def delta(changes: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """groups, n_rows, <c>_sum and <c>_n that a change set adds; zeros left out."""
    sign = F.col(SIGN_COL)
    aggs = [F.sum(sign).cast("long").alias(ROWS)]
    for c in sums:
        aggs += [F.coalesce(F.sum(F.col(c).cast(SUM) * sign), F.lit(0)).cast(SUM).alias(f"{c}_sum"),
                 F.sum(F.when(F.col(c).isNotNull(), sign).otherwise(0)).cast("long").alias(f"{c}_n")]
    values = [ROWS, *[f"{c}_{x}" for c in sums for x in ("sum", "n")]]
    return changes.groupBy(*groups).agg(*aggs).filter(" OR ".join(f"`{v}` <> 0" for v in values))


def apply(spark: SparkSession, path: str, change: DataFrame, groups: list[str], epoch: int, n_buckets: int | None = None) -> None:
    """Add a delta to the gold table at ``path``.  Each group notes the epoch
    that last changed it: where a run failed half way, the same epoch again
    changes the groups that it had not reached.  Groups without rows stay with
    their note and are not read.  Epochs of a table ascend."""
    # groups may be null in any column, which keys may not: the key is their text
    change = change.withColumn("_group", F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}))
    values = [c for c in change.columns if c not in (*groups, "_group")]
    gold = read_table_or_none(spark, path, change.select("_group").distinct(), "_group")
    new = change.withColumn(APPLIED, F.lit(epoch).cast("long"))
    if gold is not None:
        old = gold.select("_group", F.col(APPLIED).alias("_then"), *[F.col(v).alias(f"_{v}") for v in values])
        new = (new.join(old, "_group", "left").filter(F.coalesce(F.col("_then") < epoch, F.lit(True)))
               .withColumns({v: (F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).cast(change.schema[v].dataType) for v in values})
               .select(*new.columns))
    upsert_table(spark, path, new, "_group", n_buckets)


def read(spark: SparkSession, path: str, groups: list[str], sums: list[str] = ()) -> DataFrame:
    """The gold table: groups, n_rows, and for each summed column its sum
    (null without values) and mean."""
    rows = spark.read.parquet(path).filter(F.col(ROWS) > 0)
    out = [*groups, ROWS]
    for c in sums:
        total = F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum"))
        out += [total.alias(f"{c}_sum"), (total / F.col(f"{c}_n")).alias(f"{c}_mean")]
    return rows.select(*out)


def rebuilt(silver: DataFrame, groups: list[str], sums: list[str]) -> DataFrame:
    """The same by a full pass over silver."""
    out = delta(silver.withColumn(SIGN_COL, F.lit(1)), groups, sums)
    cols = [*groups, ROWS]
    for c in sums:
        total = F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum"))
        cols += [total.alias(f"{c}_sum"), (total / F.col(f"{c}_n")).alias(f"{c}_mean")]
    return out.select(*cols)
