"""JSON column helpers: extraction (E1-E5), unnest (J6), re-nest.

Payloads are kept as JSON text at rest.  A projection that needs several
typed fields parses the text once with ``try_parse_json`` (VARIANT) in its own
``select`` and reads every field from that value with ``try_variant_get``; the
text extractor ``get_json_object`` is used for string fields, whose result must
keep nested values as compact JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Platform type -> Spark SQL type (fixed mapping of the data model).
PLATFORM_TYPES = {
    "string": "string",
    "int": "bigint",
    "float": "double",
    "bool": "boolean",
    "timestamp": "timestamp_ntz",
    "json": "string",
    "array": "string",
}

# to_json options so that nulls keep their keys and NTZ timestamps keep
# microseconds (default format has milliseconds only).
TO_JSON_OPTS = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_path(field: str) -> str:
    """Bracket JSONPath for one top-level key (safe for blanks, dots and
    double quotes; no path can name a key with a single quote)."""
    return f"$['{field}']"


def dotted_path(path: str) -> str:
    """'a.b.c' or '$.a.b' -> "$['a']['b']['c']" (leading '$.' stripped)."""
    p = path[2:] if path.startswith("$.") else path
    p = p.lstrip("$.")
    if not p:
        return "$"
    return "$" + "".join("['" + part + "']" for part in p.split("."))


def parse(c) -> Column:
    """Malformed JSON -> NULL."""
    return F.try_parse_json(_c(c))


def text(c, field: str) -> Column:
    """E1 ``payload->>'f'``: string value unquoted, nested value as JSON text,
    JSON null -> NULL."""
    if "'" in field:
        return F.from_json(_c(c), "map<string,string>")[field]
    return F.get_json_object(_c(c), json_path(field))


def is_json(c) -> Column:
    """Whether a text is one whole JSON value.  Spark's parsers ignore what
    follows a value, so the text is read as the first of two elements: one
    that closes the brackets itself leaves no second.  The second is a text
    that the first does not hold."""
    mark = F.when(_c(c).contains("after"), F.lit("behind")).otherwise(F.lit("after"))
    parsed = F.from_json(F.concat(F.lit("["), _c(c), F.lit('\n,"'), mark, F.lit('"]')), "array<string>")
    return F.coalesce((F.size(parsed) == 2) & (F.get(parsed, F.lit(1)) == mark), F.lit(False))


def json_elements(c) -> Column:
    """The elements of a JSON array, each as JSON text with its key order and
    number kinds.  Scalars are spelled by the variant, which tells a string
    from what it looks like; a container that no variant can hold (repeated
    keys) keeps its text."""
    texts = F.from_json(_c(c), "array<string>")
    values = F.try_variant_get(F.try_parse_json(_c(c)), "$", "array<variant>")
    return F.transform(texts, lambda x, i: F.when(
        F.coalesce(F.schema_of_variant(F.get(values, i)).rlike("^(OBJECT|ARRAY)"), F.lit(True)) & x.isNotNull(), x)
        .otherwise(F.coalesce(F.to_json(F.get(values, i)), F.lit("null"))))


def text_path(c, path: str) -> Column:
    return F.get_json_object(_c(c), dotted_path(path))


def typed(v, field: str, platform_type: str) -> Column:
    """E2 tolerant typed extract from a parsed VARIANT: bad value -> NULL."""
    return F.try_variant_get(*_key(v, field), PLATFORM_TYPES[platform_type])


def strict(v, field: str, platform_type: str) -> Column:
    """E3 strict typed extract: a bad value raises."""
    return F.variant_get(*_key(v, field), PLATFORM_TYPES[platform_type])


def _key(v, field: str) -> tuple[Column, str]:
    """The variant and the path that name one top-level key."""
    if "'" in field:
        return F.try_variant_get(_c(v), "$", "map<string,variant>")[field], "$"
    return _c(v), json_path(field)


def tolerant_timestamp(c) -> Column:
    """E4 ``TRY_CAST(text AS TIMESTAMP)``."""
    return _c(c).try_cast("timestamp_ntz")


def default_if_empty(c, default: str = "UNKNOWN") -> Column:
    """E5 ``COALESCE(NULLIF(x, ''), 'UNKNOWN')``."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def row_json(cols=None) -> Column:
    """L9 / S1 payload: one JSON object per row, null fields kept."""
    s = F.struct(*(cols or [F.col("*")]))
    return F.to_json(s, TO_JSON_OPTS)


def unnest(df: DataFrame, json_col, path: str, alias: str = "elem") -> DataFrame:
    """J6 lateral unnest of a JSON array held at ``path`` inside ``json_col``.

    Element text is kept as JSON; rows with no array are dropped (inner
    semantics of ``CROSS JOIN UNNEST``).  Runs per row, no shuffle.
    """
    arr = F.from_json(F.get_json_object(_c(json_col), dotted_path(path)), "array<string>")
    return df.select("*", F.posexplode(arr).alias(f"{alias}_pos", alias))


def unnest_variant(df: DataFrame, v_col, path: str, alias: str = "elem") -> DataFrame:
    """J6 on an already parsed VARIANT: the array at ``path`` exploded to
    VARIANT elements (no re-parse of the element text); rows without an
    array are dropped."""
    arr = F.try_variant_get(_c(v_col), dotted_path(path), "array<variant>")
    return df.select("*", F.posexplode(arr).alias(f"{alias}_pos", alias))


def renest(df: DataFrame, group_cols: list[str], item_cols: list[str],
           order_col: str, alias: str = "items") -> DataFrame:
    """A6 re-nest child rows to one JSON array per parent, ordered by
    ``order_col``.

    Children are dealt into ranges of (parent, order), so that a parent with
    very many spreads over as many tasks as it fills; each range's children
    become one text there, and a parent's texts are joined in order.  No array
    of all children of a parent exists before the output cell.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = [order_col] + [c for c in item_cols if c != order_col]
    ranged = df.repartitionByRange(n, *group_cols, order_col).withColumn("_range", F.spark_partition_id())
    parts = ranged.groupBy(*group_cols, "_range").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*ordered))), TO_JSON_OPTS).alias("_t"))
    parts = parts.withColumn("_t", F.substring("_t", F.lit(2), F.length("_t") - 2))          # without the brackets
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_range", "_t"))), lambda x: x["_t"])
    return parts.groupBy(*group_cols).agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias(alias))


def renest_structs(df: DataFrame, group_cols: list[str], item_cols: list[str],
                   order_col: str, alias: str = "items") -> DataFrame:
    """A6 as a native ``array<struct>`` column (field order kept)."""
    ordered = [order_col] + [c for c in item_cols if c != order_col]
    agg = F.array_sort(F.collect_list(F.struct(*ordered)))
    return df.groupBy(*group_cols).agg(agg.alias(alias))
