"""Schema inference over whole bronze tables.

One row per (record, key) is produced by exploding the parsed payload; every
rule is then a grouped aggregate keyed by the payload key, with partial
aggregation before the shuffle, so a key present in every record costs one row
per map task after the combine.  The field frame is bounded by the number of
distinct keys (schema), never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.functions.pii import is_pii_col
from tierline.session import cut_lineage

# Fixed patterns of the type rules (text values are stripped first).
ISO_TIMESTAMP = r"(?U)^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
ISO_DATE = r"(?U)^\d{4}-\d{2}-\d{2}$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
EMAIL = r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"(?iU)^https?://\S+$"
ID_FIELD = r"(?i)(^|_)(id|uuid|guid|key|token|hash|ref|code|sku|slug)$"
# Python int() / float() text grammar: sign, digits with single underscores,
# optional fraction and exponent, or nan / inf / infinity.
_DIG = r"\d(?:_?\d)*"
INT_TEXT = rf"(?U)^[+-]?{_DIG}$"
FLOAT_TEXT = (rf"(?U)^[+-]?(?:(?:{_DIG}\.(?:{_DIG})?|\.{_DIG}|{_DIG})(?:[eE][+-]?{_DIG})?"
              r"|(?i:nan|inf|infinity))$")
PK_SUFFIXES = ["_uuid", "_key", "_ref"]
SAMPLES = 3
SAMPLE_CHARS = 80


def _kind(schema_col):
    """JSON kind of one value from ``schema_of_variant``.

    An integer literal that fits a long parses to BIGINT; a number written
    with a fraction or exponent becomes DECIMAL / DOUBLE, and the parser
    drops zero fractions (``1.0`` -> DECIMAL(1,0)).  So DECIMAL(p,0) is a
    float literal unless p >= 19 (an integer literal beyond a long)."""
    s = schema_col
    return (F.when(s == "STRING", "string").when(s.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "bool")
            .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT")
                  | s.rlike(r"^DECIMAL\((19|[2-9]\d|\d{3,}),0\)$"), "int")
            .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "float")
            .when(s.startswith("ARRAY"), "array")
            .when(s.startswith("OBJECT"), "object").otherwise("string"))


def _entries(v) -> Column:
    """Array of (key, kind, stripped, value) of an object variant, null for
    any other.  Kinds and stripped texts are worked out here, once a value: as
    columns of a plain projection they would be repeated inside of every rule
    that reads them."""
    held = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    held = F.transform(held, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.schema_of_variant(e["value"]).alias("schema")))
    held = F.transform(held, lambda e: F.struct(e["key"].alias("key"), _kind(e["schema"]).alias("kind"), e["value"].alias("value")))
    # the text rules only ever look at string values (numbers are decided by
    # kind, and bool / list / object values fail every text rule)
    held = F.transform(held, lambda e: F.struct(
        e["key"].alias("key"), e["kind"].alias("kind"),
        F.when(e["kind"] == "string", F.variant_get(e["value"], "$", "string")).alias("text"), e["value"].alias("value")))
    # the pattern only runs where the first or last character can be white space
    return F.transform(held, lambda e: F.struct(
        e["key"].alias("key"), e["kind"].alias("kind"),
        F.when(_printed(e["text"].substr(1, 1)) & _printed(e["text"].substr(-1, 1)), e["text"])
        .otherwise(F.regexp_replace(e["text"], r"(?U)^\s+|\s+$", "")).alias("stripped"),
        e["value"].alias("value")))


def _printed(char: Column) -> Column:
    """Whether a character is one of ASCII's that are printed."""
    return (char > " ") & (char < "\x7f")


def key_values(bronze: DataFrame, position: str, payload: str = "payload",
               entity: str | None = None, sentinel: bool = False) -> DataFrame:
    """(entity, rec, key, key_pos, kind, stripped, value) for every key of
    every object payload.  Key order comes from the text (``json_object_keys``),
    since VARIANT objects store keys sorted."""
    ent = F.col(entity) if entity else F.lit("")
    base = bronze.select(ent.alias("entity"), F.col(position).alias("rec"),
                         F.col(payload).alias("_p"), F.try_parse_json(payload).alias("_v"))
    # what is no object has no entries (a filter would parse every record twice)
    objs = base.select("entity", "rec", F.json_object_keys("_p").alias("_keys"), "_v")
    entries = _entries("_v")
    if sentinel:
        # one extra (null key) row per record: record totals in the same pass
        entries = F.concat(entries, F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("null").alias("kind"),
                                                     F.lit(None).cast("string").alias("stripped"), F.lit(None).cast("variant").alias("value"))))
    vals = objs.select("entity", "rec", "_keys", F.inline(entries))
    # no join: the text position of a key is looked up in the record's own key list
    return vals.select("entity", "rec", "key",
                       (F.array_position("_keys", F.col("key")) - 1).alias("key_pos"),
                       "kind", "stripped", "value")


def _value_text(kind, value):
    """Text of a value: strings unquoted, anything else as compact JSON."""
    return F.when(kind == "string", F.variant_get(value, "$", "string")).otherwise(F.to_json(value))


def infer_fields(bronze: DataFrame, position: str, payload: str = "payload",
                 entity: str | None = None, entity_name: str | None = None,
                 sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """One row per key: entity, name, ordinal (first-seen order),
    data_type, nullable, is_pii, samples (first three non-null values in record
    order, JSON text cut to ``sample_chars`` for nested ones; none for PII),
    n_present, is_pk.

    Two passes over the records, neither of which sorts or shuffles the
    (record, key) rows whole: the rule aggregate (partial aggregation per key),
    and the samples, from the few records that can hold them
    (``_reach``).  Record totals ride along in the rule aggregate as one
    sentinel row per record.
    """
    kv = key_values(bronze, position, payload, entity, sentinel=True)
    nn = F.col("kind") != "null"
    stripped = F.col("stripped")

    def all_(cond):
        # vacuous truth over non-null values; nulls are not counted
        return F.coalesce(F.bool_and(F.when(nn, cond)), F.lit(True))

    g = kv.groupBy("entity", "key").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("rec").alias("first_rec"),
        F.min_by("key_pos", "rec").alias("first_pos"),
        F.count_if(nn).alias("n_present"),
        all_(F.col("kind") == "array").alias("all_array"),
        all_(F.col("kind") == "object").alias("all_object"),
        all_(F.col("kind") == "bool").alias("all_bool"),
        all_(F.col("kind") == "int").alias("all_int"),
        all_(F.col("kind").isin("int", "float")).alias("all_num"),
        all_(F.col("kind").isin("string", "int", "float")).alias("all_scalar_text"),
        # numbers never match the uuid / date / e-mail / url patterns
        # cheap necessary conditions first; the pattern only runs when they hold
        all_(F.coalesce((F.length(stripped) == 36) & stripped.rlike(UUID), F.lit(False))).alias("t_uuid"),
        all_(F.coalesce((F.length(stripped) >= 16) & stripped.rlike(ISO_TIMESTAMP), F.lit(False))).alias("t_ts"),
        all_(F.coalesce((F.length(stripped) == 10) & stripped.rlike(ISO_DATE), F.lit(False))).alias("t_date"),
        all_(F.coalesce(stripped.contains("@") & stripped.rlike(EMAIL), F.lit(False))).alias("t_email"),
        all_(F.coalesce(F.lower(F.substring(stripped, 1, 4)).eqNullSafe("http") & stripped.rlike(URL),
                        F.lit(False))).alias("t_url"),
        # a float value's text is never int text (its str() has a '.' or 'e')
        all_((F.col("kind") == "int") | F.coalesce(stripped.rlike(INT_TEXT), F.lit(False))).alias("t_int"),
        all_(F.col("kind").isin("int", "float") | F.coalesce(stripped.rlike(FLOAT_TEXT), F.lit(False)))
        .alias("t_float"),
        *_least_by_share(nn),
    )
    g = cut_lineage(g)                       # a row per key; the fields and the samples' reach read it
    # totals from the sentinel group, by a window over the aggregated rows
    # (keys per entity) rather than a self join that would recompute them
    per_entity = Window.partitionBy("entity")
    g = g.withColumn("total", F.max(F.when(F.col("key").isNull(), F.col("n_rows"))).over(per_entity)) \
        .filter(F.col("key").isNotNull())
    is_id = F.col("key").rlike(ID_FIELD)
    # bool / list / object values inside a mixed set never satisfy a text rule
    txt = F.col("all_scalar_text")
    dtype = (F.when(F.col("n_present") == 0, "string")
             .when(F.col("all_array"), "array").when(F.col("all_object"), "json")
             .when(F.col("all_bool"), "bool").when(F.col("all_int"), "int")
             .when(F.col("all_num"), "float")
             .when(txt & F.col("t_uuid"), "string")
             .when(txt & F.col("t_ts"), "timestamp").when(txt & F.col("t_date"), "timestamp")
             .when(txt & F.col("t_email"), "string").when(txt & F.col("t_url"), "string")
             .when(txt & ~is_id & F.col("t_int"), "int")
             .when(txt & ~is_id & F.col("t_float"), "float")
             .otherwise("string"))
    w = Window.partitionBy("entity").orderBy("first_rec", "first_pos")     # one row per key
    fields = g.select(
        "entity", F.col("key").alias("name"),
        (F.row_number().over(w) - 1).alias("ordinal"),
        dtype.alias("data_type"),
        (F.col("n_present") < F.col("total")).alias("nullable"),
        is_pii_col("key").alias("is_pii"),
        F.col("n_present").cast("long").alias("n_present"),
    )
    samples = first_values(bronze, g, position, payload, entity, SAMPLES, sample_chars)
    fields = fields.join(samples, ["entity", "name"], "left").withColumn(
        "samples", F.when(F.col("is_pii"), F.array().cast("array<string>"))
        .otherwise(F.coalesce(F.col("samples"), F.array().cast("array<string>"))))
    return with_primary_key(fields, entity_name)


#: Shares that records are dealt into to find how far the first values reach.
SHARES = 12


def _least_by_share(nn) -> list[Column]:
    """Aggregates over (record, key) rows: the least record with a non-null
    value in each share of the records."""
    share = F.pmod(F.xxhash64("rec"), F.lit(SHARES))
    return [F.min(F.when(nn & (share == i), F.col("rec"))).alias(f"_least{i}") for i in range(SHARES)]


def _reach(k: int) -> Column:
    """A record up to which a key has ``k`` non-null values at least: least
    records of different shares are different rows, so the k-th of them comes
    no earlier than the k-th value.  Null (no bound) where fewer shares have
    rows."""
    least = F.array_sort(F.array_compact(F.array(*[f"_least{i}" for i in range(SHARES)])))
    return F.get(least, F.lit(k - 1))


def first_values(bronze: DataFrame, keys: DataFrame, position: str, payload: str, entity: str | None,
                 k: int, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """First ``k`` non-null values per key in record order (null positions
    first).  ``keys`` (a row a key) says how far they reach: records beyond
    all keys' reach are not parsed, values beyond their key's are not ranked."""
    reach = keys.select(F.col("entity").alias("_e"), F.col("key").alias("_k"), _reach(k).alias("_reach"))
    # per entity, the farthest; no bound where a key has none
    far = reach.groupBy("_e").agg(F.max("_reach").alias("_far"), F.max(F.col("_reach").isNull()).alias("_open"))
    ent, rec = F.col(entity) if entity else F.lit(""), F.col(position)
    near = bronze.join(F.broadcast(far), ent.eqNullSafe(F.col("_e")) & (rec.isNull() | F.col("_open") | (rec <= F.col("_far"))), "left_semi")
    kv = key_values(near, position, payload, entity).filter((F.col("kind") != "null") & F.col("key").isNotNull())
    kv = kv.join(F.broadcast(reach), F.col("entity").eqNullSafe(F.col("_e")) & (F.col("key") == F.col("_k")))
    nn = kv.filter(F.col("rec").isNull() | F.col("_reach").isNull() | (F.col("rec") <= F.col("_reach"))).select(
        "entity", F.col("key").alias("name"), "rec", "kind", "value")
    w = Window.partitionBy("entity", "name").orderBy("rec")
    top = nn.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= k)
    # text is built for the survivors only
    text = _value_text(F.col("kind"), F.col("value"))
    top = top.withColumn("text", F.when(F.col("kind").isin("array", "object"), F.substring(text, 1, sample_chars))
                         .otherwise(text))
    return top.groupBy("entity", "name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "text"))), lambda s: s["text"])
        .alias("samples"))


def with_primary_key(fields: DataFrame, entity_name: str | None = None) -> DataFrame:
    """P6 key guess per entity: ``id``; ``{entity minus trailing s}_id``; first
    ``*_id`` except ``tenant_id``; first ``_uuid/_key/_ref``; else none."""
    n = F.col("name")
    ent = F.lit(entity_name) if entity_name else F.col("entity")
    singular_id = F.concat(F.regexp_replace(ent, "s+$", ""), F.lit("_id"))
    rank = (F.when(n == "id", 1)
            .when((F.length(ent) > 0) & (n == singular_id), 2)
            .when(n.endswith("_id") & (n != "tenant_id"), 3)
            .when(n.endswith(PK_SUFFIXES[0]) | n.endswith(PK_SUFFIXES[1]) | n.endswith(PK_SUFFIXES[2]), 4))
    # a window over the field rows (schema-sized) instead of aggregate + join
    pick = F.min_by(F.when(rank.isNotNull(), n), F.when(rank.isNotNull(), F.struct(rank, F.col("ordinal"))))
    out = fields.withColumn("_pk", pick.over(Window.partitionBy("entity")))
    return out.withColumn("is_pk", F.coalesce(F.col("name") == F.col("_pk"), F.lit(False))).drop("_pk")


def infer_csv(bronze: DataFrame, position: str, entity: str | None = None) -> DataFrame:
    """P7 inference over CSV landings: the same rules, every value text."""
    return infer_fields(bronze, position, entity=entity)
