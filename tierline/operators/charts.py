"""Shaping data for charts.

The column profile unpivots a table into (column, value text) rows with
``stack`` and evaluates every rule as one grouped aggregate per column, so a
wide table costs one pass.  The rules run over all non-empty values of a
column (the dashboard looked at the first 5 / 30 values of a result page).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the profile rules.
UNPLOTTABLE_NAME = r"(?i)^(id|.*_id|uid|uuid|guid|pk|key|hash|token|slug|url|href|link)$"
DATE_NAME_WORD = r"(?i)\b(date|time|timestamp)\b"
DATE_NAME_SUFFIX = r"(?i)(_at|_on|_date|_time)$"
DATE_NAME_PREFIX = r"(?i)^(created|updated|started|ended|deleted|modified)_"
LABEL_NAME = r"(?i)^(name|label|title|description|category|type|status|kind|tag|group|region|country|city)$"
METRIC_SKIP = r"(?i)^(count|n|total)$"
NUMERIC_SHARE = 0.7
CATEGORY_MAX = 25
LONG_TEXT = 80
YEAR_2000 = "2000-01-01 00:00:00"
#: A sketch holds the hashes of up to 2 to this many distinct values.
DISTINCT_BITS = 8


def group_bars(df: DataFrame, x: str, y: str | None = None, agg: str = "sum",
               descending: bool = True) -> DataFrame:
    """A7 group sum (or count) per category, sorted by the value."""
    val = F.sum(y) if agg == "sum" else F.count(F.lit(1))
    g = df.groupBy(x).agg(val.alias("value"))
    return g.orderBy(F.col("value").desc() if descending else F.col("value"), x)


def top_bars(df: DataFrame, x: str, label: str, k: int = 20) -> DataFrame:
    """L7 top 20 rows by a numeric value."""
    return df.orderBy(F.col(x).desc(), F.col(label)).limit(k)


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """A8 equal-width bins between min and max (max falls in the last bin):
    one pass for the bounds (one row), one grouped count."""
    mn, mx = df.agg(F.min(col), F.max(col)).first()
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (mx - mn) / bins if mx != mn else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(mn)) / F.lit(mx - mn if mx != mn else 1.0) * bins) + 1,
                F.lit(bins)).cast("int")
    g = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", (F.lit(mn) + (F.col("bin") - 1) * width).alias("lo"),
                    (F.lit(mn) + F.col("bin") * width).alias("hi"), "n")


def unpivot_text(df: DataFrame) -> DataFrame:
    """(column, ordinal, value text) for every cell (``stack``)."""
    cells = [x for i, c in enumerate(df.columns)
             for x in (F.lit(c), F.lit(i), F.col("`" + c.replace("`", "``") + "`").cast("string"))]
    return df.select(F.stack(F.lit(len(df.columns)), *cells).alias("col", "ordinal", "v"))


def profile_columns(df: DataFrame) -> DataFrame:
    """P11 per column: unplottable, numeric, date_like, label, categorical."""
    u = unpivot_text(df)
    ne = F.col("v").isNotNull() & (F.col("v") != "")
    trimmed = F.trim(F.col("v"))

    def all_ne(cond):
        return F.coalesce(F.bool_and(F.when(ne, cond)), F.lit(False))

    g = u.groupBy("col", "ordinal").agg(
        F.count_if(ne).alias("n"),
        F.count_if(ne & trimmed.try_cast("double").isNotNull()).alias("n_num"),
        all_ne(F.col("v").rlike(r"^https?://")).alias("all_url"),
        all_ne(trimmed.startswith("[") | trimmed.startswith("{")).alias("all_json"),
        all_ne(F.length("v") > LONG_TEXT).alias("all_long"),
        all_ne(F.col("v").rlike(r"\d{4}") &
               (F.col("v").try_cast("timestamp_ntz") > F.lit(YEAR_2000).cast("timestamp_ntz"))).alias("all_date"),
        # the hashes of the distinct values, in full while they are few: what
        # is counted up to CATEGORY_MAX is exact, and a column of ids holds no more
        F.theta_sketch_estimate(F.theta_sketch_agg(F.when(ne, F.col("v")), F.lit(DISTINCT_BITS))).alias("n_distinct"),
    )
    # only where no value repeats does a larger count matter: a sketch of more
    # values than it holds is an estimate, the number of rows is not
    g = g.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    name = F.col("col")
    unplottable = name.rlike(UNPLOTTABLE_NAME) | (F.col("n") == 0) | F.col("all_url") | F.col("all_json") \
        | F.col("all_long")
    date_like = name.rlike(DATE_NAME_WORD) | name.rlike(DATE_NAME_SUFFIX) | name.rlike(DATE_NAME_PREFIX) \
        | F.col("all_date")
    numeric = (F.col("n") > 0) & (F.col("n_num") / F.col("n") >= NUMERIC_SHARE)
    categorical = ~((F.col("n_distinct") == F.col("n")) & (F.col("n") > 5)) & \
        (F.col("n_distinct") >= 2) & (F.col("n_distinct") <= CATEGORY_MAX)
    return g.select(F.col("col").alias("name"), "ordinal", unplottable.alias("unplottable"),
                    numeric.alias("numeric"), date_like.alias("date_like"),
                    name.rlike(LABEL_NAME).alias("label"), categorical.alias("categorical"))


def choose_chart(profile: DataFrame) -> DataFrame:
    """P12 one row: chart type and axes from the profile (a frame with one row
    per column, so this aggregate is tiny)."""
    p = profile.filter(~F.col("unplottable"))
    p = p.withColumn("is_date", F.col("date_like")) \
        .withColumn("is_num", ~F.col("date_like") & F.col("numeric")) \
        .withColumn("is_label", ~F.col("date_like") & ~F.col("numeric") & F.col("label")) \
        .withColumn("is_cat", ~F.col("date_like") & ~F.col("numeric") & ~F.col("label") & F.col("categorical"))

    def first(cond, rank=None):
        r = F.col("ordinal") if rank is None else rank
        return F.min_by(F.when(cond, F.col("name")), F.when(cond, r))

    nums = F.count_if("is_num")
    labels_first = first(F.col("is_label") | F.col("is_cat"),
                         F.when(F.col("is_label"), F.col("ordinal")).otherwise(F.col("ordinal") + 100000))
    metric = F.coalesce(first(F.col("is_num") & ~F.col("name").rlike(METRIC_SKIP)), first(F.col("is_num")))
    second_num = F.element_at(F.array_sort(F.collect_list(F.when(F.col("is_num"),
                                                                 F.struct("ordinal", "name")))), 2)["name"]
    a = p.agg(first(F.col("is_date")).alias("d0"), first(F.col("is_num")).alias("n0"), nums.alias("nn"),
              labels_first.alias("l0"), metric.alias("metric"), second_num.alias("n1"))
    has_d, has_n, has_l = F.col("d0").isNotNull(), F.col("nn") > 0, F.col("l0").isNotNull()
    kind = F.when(has_d & has_n, "time-series").when(has_l & has_n, "bar") \
        .when(F.col("nn") >= 2, "scatter").when(F.col("nn") == 1, "histogram").otherwise("none")
    x = F.when(has_d & has_n, F.col("d0")).when(has_l & has_n, F.col("metric")) \
        .when(F.col("nn") >= 1, F.col("n0")).otherwise(F.lit(""))
    y = F.when(has_d & has_n, F.col("n0")).when(has_l & has_n, F.col("l0")) \
        .when(F.col("nn") >= 2, F.col("n1")).otherwise(F.lit(""))
    y2 = F.when(~(has_d & has_n) & ~(has_l & has_n) & (F.col("nn") >= 2), F.col("l0"))
    return a.select(kind.alias("chart"), x.alias("x"), y.alias("y"), y2.alias("y2"))


def chart_cast(df: DataFrame, profile_rows: list[dict]) -> DataFrame:
    """P13 numeric columns to double, date columns to timestamp, for plotting
    (``profile_rows`` is the collected profile: one row per column)."""
    kinds = {r["name"]: r for r in profile_rows}
    out = []
    for c in df.columns:
        r = kinds.get(c)
        if r and not r["unplottable"] and r["date_like"]:      # the date cast is applied last
            out.append(F.col(c).cast("string").try_cast("timestamp_ntz").alias(c))
        elif r and not r["unplottable"] and r["numeric"]:
            out.append(F.col(c).cast("string").try_cast("double").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
