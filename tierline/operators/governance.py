"""Access and masking (G4-G9), config overlay (E16), secret redaction.

Role -> layer and role -> permission rules are fixed tables of a few rows;
they are built as literal frames and broadcast (their size is fixed by the
rules, not by data).
"""

from __future__ import annotations

import re
from functools import reduce

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions.pii import is_pii_name, mask_for

LAYERS = ["bronze", "silver", "gold"]
# Layers each role may query.
ROLE_LAYERS = {
    "owner": ["bronze", "silver", "gold"],
    "admin": ["bronze", "silver", "gold"],
    "engineer": ["bronze", "silver", "gold"],
    "analyst": ["silver", "gold"],
    "viewer": ["gold"],
}
PII_ROLES = ["owner", "admin"]
# Role -> resource -> allowed actions.
RESOURCES = ["catalogue", "integration", "transform", "agent", "user"]
ACTIONS = ["read", "write", "approve", "admin"]
_ALL = ["read", "write", "approve", "admin"]
ROLE_PERMISSIONS = {
    "owner": {"catalogue": _ALL, "integration": _ALL, "transform": _ALL,
              "agent": ["read", "write"], "user": _ALL},
    "admin": {"catalogue": _ALL, "integration": _ALL, "transform": _ALL,
              "agent": ["read", "write"], "user": ["read", "write", "admin"]},
    "engineer": {"catalogue": ["read", "write", "approve"], "integration": ["read", "write", "approve"],
                 "transform": ["read", "write", "approve"], "agent": ["read", "write"], "user": ["read"]},
    "analyst": {"catalogue": ["read", "write"], "integration": ["read", "write"],
                "transform": ["read", "write"], "agent": ["read", "write"], "user": ["read"]},
    "viewer": {"catalogue": ["read"], "integration": ["read"], "transform": ["read"],
               "agent": ["read"], "user": []},
}
# Config keys whose value is a secret.
SECRET_KEY_PARTS = ["token", "key", "secret", "password", "credential", "auth", "api_key"]
REDACTED_SECRET = "***"


def role_layers(spark: SparkSession) -> DataFrame:
    """G5 role -> allowed layer rows (unknown roles have none here and are
    treated as viewer by ``layers_for``)."""
    rows = [(r, ly) for r, ls in ROLE_LAYERS.items() for ly in ls]
    return spark.createDataFrame(rows, "role string, layer string")


def layers_for(role: str | None, entity_api: bool = False) -> list[str]:
    ls = ROLE_LAYERS.get(role or "viewer", ROLE_LAYERS["viewer"])
    return [x for x in ls if not (entity_api and x == "bronze")]


def permission_matrix(spark: SparkSession) -> DataFrame:
    """G8 (role, resource, action) rows that are allowed."""
    rows = [(r, res, a) for r, m in ROLE_PERMISSIONS.items() for res, acts in m.items() for a in acts]
    return spark.createDataFrame(rows, "role string, resource string, action string")


def can(df: DataFrame, matrix: DataFrame, role_col="role", resource_col="resource",
        action_col="action", superuser_col: str | None = None) -> DataFrame:
    """G8 adds ``allowed`` to request rows: superuser always; a missing role
    counts as viewer; an unknown role gets nothing.  The matrix is a
    fixed-size literal frame, broadcast."""
    m = F.broadcast(matrix.select(F.col("role").alias("_r"), F.col("resource").alias("_res"),
                                  F.col("action").alias("_a"), F.lit(True).alias("_ok")))
    role = F.coalesce(F.nullif(F.col(role_col), F.lit("")), F.lit("viewer"))
    j = df.join(m, (role == F.col("_r")) & (F.col(resource_col) == F.col("_res"))
                & (F.col(action_col) == F.col("_a")), "left")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    if superuser_col:
        ok = F.coalesce(F.col(superuser_col), F.lit(False)) | ok
    return j.withColumn("allowed", ok).drop("_r", "_res", "_a", "_ok")


def mask_frame(df: DataFrame, role: str | None, pii_columns: list[str] | None = None) -> DataFrame:
    """G4 mask flagged columns unless the role may see PII.  Flags come from
    the catalogue (``pii_columns``) or, without one, from the column names."""
    if role in PII_ROLES:
        return df
    flagged = set(pii_columns) if pii_columns is not None else {c for c in df.columns if is_pii_name(c)}
    return df.select(*[mask_for(c, F.col(f"`{c}`")).alias(c) if c in flagged else F.col(f"`{c}`")
                       for c in df.columns])


class QueryDenied(Exception):
    pass


#: Parts a read-only query may be made of, by the parser's names.  Everything
#: else (commands, inserts, table functions, paths) is denied.
_QUERY_PARTS = frozenset((
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except",
    "Join", "LateralJoin", "AsOfJoin", "SubqueryAlias", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving", "UnresolvedInlineTable",
    "UnresolvedSubqueryColumnAliases", "WithWindowDefinition", "Window", "Generate", "OneRowRelation", "Pivot", "Unpivot", "Expand",
    "OrderByAll", "UnresolvedOrdinal"))
#: Function groups of the session's registry that compute from their arguments.
_FUNCTION_GROUPS = frozenset((
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs",
    "date_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "operator_funcs", "predicate_funcs",
    "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs", "xml_funcs"))
#: The others that are granted one by one.
_OTHER_FUNCTIONS = frozenset(("typeof", "uuid", "current_date", "current_timestamp", "now", "localtimestamp", "coalesce", "equal_null"))
#: Unresolved parts of expressions that name columns, or functions judged by name.
_OPEN_EXPRESSIONS = frozenset((
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedStarExceptOrReplace", "UnresolvedRegex", "UnresolvedAlias", "UnresolvedExtractValue",
    "UnresolvedNamedLambdaVariable", "UnresolvedWindowExpression", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedOrdinal"))


def _parsed_parts(gateway, part):
    """All nodes of a parsed statement: plans, expressions, and those held in
    lists, maps, options and tuples of them."""
    if not isinstance(part, JavaObject):
        return
    if is_instance_of(gateway, part, "org.apache.spark.sql.catalyst.trees.TreeNode"):
        yield part
        inner = part.productIterator()
    elif is_instance_of(gateway, part, "scala.collection.IterableOnce"):
        inner = part.iterator()
    elif is_instance_of(gateway, part, "scala.Product"):
        inner = part.productIterator()
    else:
        return
    while inner.hasNext():
        yield from _parsed_parts(gateway, inner.next())


def _granted(spark: SparkSession, parts: list[str]) -> bool:
    """Whether a called function is one of Spark's own that only computes.
    The session's registry says what the name stands for now, so neither a
    session function nor one that took a built-in name is granted."""
    if len(parts) != 1:
        return False
    jvm = spark._jvm
    name = jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[0].lower())
    found = spark._jsparkSession.sessionState().functionRegistry().lookupFunction(name)
    if found.isEmpty():
        return False
    info = found.get()
    if info.getSource() != "built-in" or info.getClassName().endswith("CallMethodViaReflection"):
        return False
    return info.getGroup() in _FUNCTION_GROUPS or parts[0].lower() in _OTHER_FUNCTIONS


def _judge_expressions(spark: SparkSession, plan) -> None:
    """Deny every function that is not granted, and names made at run time."""
    for part in _parsed_parts(spark.sparkContext._gateway, plan):
        kind = part.getClass().getSimpleName()
        if is_instance_of(spark.sparkContext._gateway, part, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
            continue                                 # judged with the relations
        if kind == "UnresolvedFunction":
            names = _sequence(part.nameParts())
        elif kind == "UnresolvedGenerator":
            names = [part.name().funcName()] if part.name().database().isEmpty() else ["", ""]
        elif ("Unresolved" in kind or "Parameter" in kind or "UDF" in kind or "Reflection" in kind) and kind not in _OPEN_EXPRESSIONS:
            raise QueryDenied(f"{kind} is not allowed in a query")
        else:
            continue
        if not _granted(spark, names):
            raise QueryDenied(f"function {'.'.join(names)} is not granted")


def _sequence(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _relations(plan, hidden: frozenset = frozenset()) -> list[tuple[int, int, list[str]]]:
    """(first, last character, name parts) of every table a parsed query names,
    subqueries included.  Names of its own WITH clauses are not tables."""
    kind = plan.getClass().getSimpleName()
    if kind not in _QUERY_PARTS:
        raise QueryDenied(f"only SELECT queries over the granted tables are allowed ({kind})")
    out = []
    if kind == "UnresolvedRelation":
        parts = _sequence(plan.multipartIdentifier())
        if not (len(parts) == 1 and parts[0].lower() in hidden):
            at = plan.origin()
            out.append((at.startIndex().get(), at.stopIndex().get(), parts))
    inner = []
    if kind == "UnresolvedWith":
        for cte in _sequence(plan.cteRelations()):
            # a clause sees the clauses before it
            out += _relations(cte._2(), hidden)
            hidden = hidden | {cte._1().lower()}
    else:
        inner = _sequence(plan.innerChildren())
    for child in [*_sequence(plan.children()), *inner]:
        out += _relations(child, hidden)
    return out


def tables_named(spark: SparkSession, sql: str) -> list[str]:
    """The tables that a query reads, as it spells them."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as exc:
        raise QueryDenied("not a query") from exc
    return [".".join(parts) for _, _, parts in _relations(plan)]


def run_query(spark: SparkSession, sql: str, role: str | None,
              tables: dict[str, DataFrame], pii: dict[str, list[str]] | None = None) -> DataFrame:
    """G6 role-scoped read-only query.

    Spark's parser reads the statement.  It must be a query, and every table
    it names (in subqueries and WITH clauses too) must be a ``layer.name`` key
    of ``tables`` in one of the role's layers; files, views, catalog tables and
    writes are denied, for every role.  So is every function but those of
    Spark's own that compute from their arguments, wherever in the statement
    and however spelled.  Exactly the parsed names are replaced by the frames,
    each masked (G4) *before* the query, so an alias cannot unmask a column
    (Q4) and a literal that looks like a table name stays a literal.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as exc:
        raise QueryDenied("not a query") from exc
    _judge_expressions(spark, plan)
    allowed, bound, at, text = set(layers_for(role)), {}, 0, []
    quoted = lambda s: s.replace("{", "{{").replace("}", "}}")
    for first, last, parts in sorted(_relations(plan)):
        key = ".".join(p.lower() if i == 0 else p for i, p in enumerate(parts))
        if len(parts) != 2 or key not in tables:
            raise QueryDenied(f"unknown table {key}")
        layer, name = key.split(".")
        if layer not in allowed:
            raise QueryDenied(f"layer {layer} is not allowed for role {role}")
        held = f"t{len(bound)}"
        bound[held] = mask_frame(tables[key], role, (pii or {}).get(key))
        # an unaliased table keeps its name for column references
        alias = "" if re.match(r"\s*(?:AS\s+)?(?!(?:%s)\b)[`A-Za-z_]" % _CLAUSES, sql[last + 1:], re.IGNORECASE) else f" AS `{name}`"
        text += [quoted(sql[at:first]), "{" + held + "}" + alias]
        at = last + 1
    return spark.sql("".join([*text, quoted(sql[at:])]), **bound)


#: Words that can follow a table without being its alias.
_CLAUSES = ("where|group|order|having|limit|offset|union|intersect|except|minus|join|inner|left|right|full|cross|outer|semi|anti|natural|on|"
            "using|lateral|window|sort|cluster|distribute|pivot|unpivot|tablesample|qualify")


def scoped(df: DataFrame, tenant_id: str) -> DataFrame:
    """G7 tenant scoping built into every control-table read."""
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))


class TenantReader:
    """G7 control tables as one tenant sees them.  Readers get this instead of
    the tables, so no query can leave the filter out."""

    def __init__(self, tables: dict[str, DataFrame], tenant_id: str):
        self._tables, self._tenant = tables, tenant_id

    def __call__(self, name: str) -> DataFrame:
        return scoped(self._tables[name], self._tenant)


# Tenant config defaults (values as JSON text).
CONFIG_DEFAULTS = {
    "llm_provider": '"ollama"',
    "llm_model": '"llama3.2"',
    "pii_masking_enabled": "true",
    "data_retention_days": "90",
    "max_connector_runs_per_day": "100",
}


def config_overlay(tenants: DataFrame, stored: DataFrame, defaults: dict | None = None) -> DataFrame:
    """E16 ``{**defaults, **stored}`` per tenant.  Every tenant gets the
    default keys (a fixed list exploded per tenant row, no join), stored
    values win, stored keys outside the defaults are kept."""
    defaults = CONFIG_DEFAULTS if defaults is None else defaults
    kv = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("_d")) for k, v in defaults.items()])
    grid = tenants.select(F.col("id").alias("tenant_id"), F.inline(kv))
    out = grid.join(stored.select("tenant_id", "key", F.col("value").alias("_s")),
                    ["tenant_id", "key"], "full_outer")
    return out.select("tenant_id", "key", F.coalesce("_s", "_d").alias("value"))


def redact_secrets(config_col) -> F.Column:
    """E17 ``map<string,string>`` config: values of secret-looking keys -> ***."""
    c = F.col(config_col) if isinstance(config_col, str) else config_col
    def is_secret(k):
        return reduce(lambda a, b: a | b, [F.lower(k).contains(p) for p in SECRET_KEY_PARTS])
    return F.transform_values(c, lambda k, v: F.when(is_secret(k), F.lit(REDACTED_SECRET)).otherwise(v))


def drop_redacted(config_col) -> F.Column:
    """E17 on import: entries whose value is the placeholder are dropped."""
    c = F.col(config_col) if isinstance(config_col, str) else config_col
    return F.map_filter(c, lambda k, v: v != F.lit(REDACTED_SECRET))
