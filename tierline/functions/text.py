"""String column helpers: name normalisation (S11), keyword extraction (M1),
layer-name rewriting of stored SQL (G9), case-insensitive search (E18)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYERS = ["bronze", "silver", "gold"]

# Stop words removed from recall keywords.
STOP_WORDS = [
    "with", "that", "this", "from", "have", "they", "will", "what",
    "when", "where", "which", "into", "some", "your", "data", "table",
]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def source_table_name(c) -> Column:
    """S11 lower-case, every non-alphanumeric character -> '_'."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}]", "_")


def tenant_slug(c) -> Column:
    """S11 tenant slug: ASCII only."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "_")


def keywords(c) -> Column:
    """M1 lower-case runs of at least four ASCII letters minus stop words;
    duplicates kept, in text order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit("([a-z]{4,})"), 1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def strip_tenant_schemas(sql) -> Column:
    """G9 ``bronze_acme.orders`` -> ``bronze.orders``."""
    return F.regexp_replace(_c(sql), r"(?i)\b(bronze|silver|gold)_[a-z0-9_]+\.", "$1.")


def inject_tenant_schemas(sql, tenant_id) -> Column:
    """G9 inverse: bare ``layer.`` -> ``layer_{slug}.`` unless already scoped."""
    out = _c(sql)
    slug = tenant_slug(tenant_id)
    for layer in LAYERS:
        out = F.regexp_replace(out, F.lit(rf"(?i)\b{layer}(?!_)\."),
                               F.concat(F.lit(f"{layer}_"), slug, F.lit(".")))
    return out


def search_any(cols: list[str], q: str | None) -> Column:
    """E18 case-insensitive substring over several columns (any match).
    Empty query -> no filter."""
    if not q:
        return F.lit(True)
    needle = F.lit(q.lower())
    return reduce(lambda a, b: a | b,
                  [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(needle)
                   for c in cols])


def exact_filters(**kv) -> Column:
    """E9 conjunction of optional equality filters; None or 'all' = off."""
    conds = [F.col(k) == F.lit(v) for k, v in kv.items() if v is not None and v != "all"]
    return reduce(lambda a, b: a & b, conds, F.lit(True))
