"""Small-side lookups.

The side's size is known only once it has been computed, and adaptive
execution then knows it in bytes: it broadcasts a side below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise keeps the shuffle join,
whose hot keys it splits.  So a lookup is a plain join; nothing is counted while
the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    return fact.join(dim, on, how)
