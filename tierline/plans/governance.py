"""Governance plans: masking (G1-G4), role layers (G5), permission matrix
(G8), scoped query (G6), config overlay (E16), secret redaction (E17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.operators import governance as G
from tierline.plans import control
from tierline.plans.common import table
from tierline.plans.inference import customer_records


def _customers(spark, sf_dir):
    return customer_records(spark, sf_dir).select("customer_id", "full_name", "email", "phone", "zip",
                                                  "segment")


def q_mask_customer(spark, sf_dir):
    return G.mask_frame(_customers(spark, sf_dir), "analyst")


_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"
_PHONE = "'+1 555 ' || lpad(CAST(c_custkey AS VARCHAR), 7, '0')"
SQL_MASK_CUSTOMER = f"""
SELECT c_custkey AS customer_id,
       array_to_string(list_transform(list_filter(regexp_split_to_array(c_name, '\\s+'), lambda x: x <> ''),
                                      lambda x: left(x, 1) || '***'), ' ') AS full_name,
       CASE WHEN strpos({_EMAIL}, '@') = 0 THEN '***'
            ELSE (CASE WHEN strpos({_EMAIL}, '@') > 1 THEN left({_EMAIL}, 1) ELSE '' END) || '***@'
                 || substr({_EMAIL}, strpos({_EMAIL}, '@') + 1) END AS email,
       CASE WHEN length(regexp_replace({_PHONE}, '\\D', '', 'g')) >= 4
            THEN '***-***-' || right(regexp_replace({_PHONE}, '\\D', '', 'g'), 4) ELSE '***' END AS phone,
       '[REDACTED]' AS zip,
       c_mktsegment AS segment
FROM customer
"""


def q_role_visible_entities(spark, sf_dir):
    """G5 + J7: entities each role may see, by layer; ``entity_api`` marks the
    entity-data path that never shows bronze."""
    ents = control.catalogue_entities(spark, sf_dir)
    rl = F.broadcast(G.role_layers(spark))   # fixed rule table
    j = ents.join(rl, "layer")
    return j.groupBy("role", "layer").agg(F.count(F.lit(1)).alias("n_entities")) \
        .withColumn("entity_api", F.col("layer") != "bronze")


_ROLE_LAYER_VALUES = ", ".join(f"('{r}', '{ly}')" for r, ls in G.ROLE_LAYERS.items() for ly in ls)
SQL_ROLE_VISIBLE = f"""
WITH e AS (SELECT CASE p_size % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END AS layer FROM part),
rl AS (SELECT * FROM (VALUES {_ROLE_LAYER_VALUES}) AS v(role, layer))
SELECT role, layer, COUNT(*) AS n_entities, layer <> 'bronze' AS entity_api
FROM e JOIN rl USING (layer) GROUP BY role, layer
"""


def q_permission_matrix(spark, sf_dir):
    """G8 per tenant, resource and action: active members allowed."""
    m = control.memberships(spark, sf_dir).filter(F.col("revoked_at").isNull())
    perms = F.broadcast(G.permission_matrix(spark))
    return m.join(perms, "role").groupBy("tenant_id", "resource", "action") \
        .agg(F.count(F.lit(1)).alias("allowed_members"))


_PERM_VALUES = ", ".join(f"('{r}', '{res}', '{a}')" for r, mm in G.ROLE_PERMISSIONS.items()
                         for res, acts in mm.items() for a in acts)
_ROLES_SQL = "['" + "', '".join(control.ROLES) + "']"
SQL_PERMISSION_MATRIX = f"""
WITH m AS (SELECT 't' || CAST(n.n_regionkey AS VARCHAR) AS tenant_id,
                  {_ROLES_SQL}[(c.c_custkey % 5) + 1] AS role
           FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal >= 0),
p AS (SELECT * FROM (VALUES {_PERM_VALUES}) AS v(role, resource, action))
SELECT tenant_id, resource, action, COUNT(*) AS allowed_members
FROM m JOIN p USING (role) GROUP BY ALL
"""


def q_scoped_query(spark, sf_dir):
    """G6 an analyst's query over silver customers; e-mail is masked before
    the query, so the alias does not unmask it (Q4)."""
    silver = _customers(spark, sf_dir)
    return G.run_query(spark, "SELECT customer_id, email AS contact, segment FROM silver.customers "
                              "WHERE segment <> 'AUTOMOBILE'",
                       "analyst", {"silver.customers": silver}, pii={"silver.customers": ["email"]})


SQL_SCOPED_QUERY = f"""
SELECT c_custkey AS customer_id,
       left({_EMAIL}, 1) || '***@' || substr({_EMAIL}, strpos({_EMAIL}, '@') + 1) AS contact,
       c_mktsegment AS segment
FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'
"""


def _supplier_tenants(spark, sf_dir):
    """One tenant per supplier (``s{key}``), so the overlay grows with data."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey", "s_name")


def q_config_overlay(spark, sf_dir):
    """E16 one tenant per supplier; even suppliers store a higher run quota,
    odd ones a custom model."""
    t = _supplier_tenants(spark, sf_dir)
    stored = (t.filter(F.col("s_suppkey") % 2 == 0)
              .select(F.col("id").alias("tenant_id"), F.lit("max_connector_runs_per_day").alias("key"),
                      (F.col("s_suppkey") * 10 + 200).cast("string").alias("value"))
              .unionByName(t.filter(F.col("s_suppkey") % 2 == 1)
                           .select(F.col("id").alias("tenant_id"), F.lit("llm_model").alias("key"),
                                   F.concat(F.lit('"model-'), F.lower("s_name"), F.lit('"')).alias("value"))))
    return G.config_overlay(t.select("id"), stored)


#: (role, statement, part of the customers it must return; none: denied)
_STATEMENTS = [
    ("viewer", "SELECT customer_id FROM silver.customers", None),
    ("analyst", "SELECT customer_id FROM silver.customers WHERE segment = 'BUILDING'", "c_mktsegment = 'BUILDING'"),
    ("owner", "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home') AS h FROM silver.customers", None),
    ("owner", "SELECT reflect /* a */ ('java.lang.System', 'getProperty', 'user.home') AS h FROM silver.customers", None),
    ("admin", "SELECT customer_id FROM silver.customers ORDER BY `java_method`('java.lang.System', 'getProperty', 'user.home')", None),
    ("admin", "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home') FROM silver.customers", None),
    ("analyst", "SELECT sum(customer_id) OVER w AS s FROM silver.customers WINDOW w AS (ORDER BY try_reflect('a', 'b'))", None),
    ("analyst", "SELECT no_such_function(customer_id) AS x FROM silver.customers", None),
    ("analyst", "SELECT input_file_name() AS x FROM silver.customers", None),
    ("analyst", "SELECT customer_id, 'reflect(x)' AS note FROM silver.customers WHERE segment <> 'reflect(''a'')'", "true"),
    ("engineer", "WITH c AS (SELECT upper(segment) AS s, transform(array(customer_id), x -> x + 1) AS n FROM silver.customers) "
                 "SELECT s, n[0] AS n FROM c WHERE s LIKE 'A%' AND n[0] IN (SELECT customer_id + 1 FROM silver.customers)", "c_mktsegment LIKE 'A%'"),
    ("analyst", "SELECT segment, count(*) AS n, max(concat_ws('-', segment, customer_id)) AS m FROM silver.customers GROUP BY segment "
                "HAVING count(*) > 0", "c_custkey IN (SELECT min(c_custkey) FROM customer GROUP BY c_mktsegment)"),
]


def q_scoped_statements(spark, sf_dir):
    """G6 what a role's statement may do: for each, whether it is allowed, and
    the number of rows that it returns."""
    tables = {"silver.customers": _customers(spark, sf_dir)}
    out = None
    for n, (role, sql, _) in enumerate(_STATEMENTS):
        try:
            got, allowed = G.run_query(spark, sql, role, tables), True
        except G.QueryDenied:
            got, allowed = tables["silver.customers"].limit(0), False
        row = got.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("statement"), F.lit(role).alias("role"), F.lit(allowed).alias("allowed"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


SQL_SCOPED_STATEMENTS = "\nUNION ALL\n".join(
    f"SELECT {n} AS statement, '{role}' AS role, {'false' if part is None else 'true'} AS allowed, count(*) AS n_rows "
    f"FROM customer WHERE {part or 'false'}" for n, (role, _, part) in enumerate(_STATEMENTS))

_DEF_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in G.CONFIG_DEFAULTS.items())
SQL_CONFIG_OVERLAY = f"""
WITH d AS (SELECT * FROM (VALUES {_DEF_VALUES}) AS v(key, value)),
s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS tenant_id, 'max_connector_runs_per_day' AS key,
             CAST(s_suppkey * 10 + 200 AS VARCHAR) AS value FROM supplier WHERE s_suppkey % 2 = 0
      UNION ALL
      SELECT 's' || CAST(s_suppkey AS VARCHAR), 'llm_model', '"model-' || lower(s_name) || '"'
      FROM supplier WHERE s_suppkey % 2 = 1),
t AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS tenant_id FROM supplier)
SELECT t.tenant_id, d.key, COALESCE(s.value, d.value) AS value
FROM t CROSS JOIN d LEFT JOIN s ON s.tenant_id = t.tenant_id AND s.key = d.key
UNION ALL
SELECT s.tenant_id, s.key, s.value FROM s WHERE s.key NOT IN (SELECT key FROM d)
"""


def q_secret_redaction(spark, sf_dir):
    """E17 connector configs with secrets, redacted for export and cleaned on
    import."""
    c = control.connectors(spark, sf_dir)
    cfg = F.create_map(
        F.lit("url"), F.concat(F.lit("https://api.example.com/"), F.col("name")),
        F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("id").cast("string")),
        F.lit("api_key"), F.sha2(F.col("name"), 256),
        F.lit("page_size"), F.lit("100"),
        F.lit("client_secret"), F.col("name"))
    red = c.select("id", G.redact_secrets(cfg).alias("cfg"))
    back = red.select("id", "cfg", G.drop_redacted("cfg").alias("clean"))
    return back.select("id", F.col("cfg")["url"].alias("url"), F.col("cfg")["Authorization"].alias("auth"),
                       F.col("cfg")["api_key"].alias("api_key"), F.col("cfg")["page_size"].alias("page_size"),
                       F.col("cfg")["client_secret"].alias("client_secret"),
                       F.size("clean").alias("kept_on_import"))


SQL_SECRET_REDACTION = """
SELECT DISTINCT user_id AS id, 'https://api.example.com/conn_' || CAST(user_id AS VARCHAR) AS url,
       '***' AS auth, '***' AS api_key, '100' AS page_size, '***' AS client_secret, 2 AS kept_on_import
FROM events WHERE user_id % 2 = 0
"""

def q_preview_masked(spark, sf_dir):
    """L3 + G4 a viewer's preview of silver customers: at the maximum of
    100, PII masked (flags from the catalogue)."""
    from tierline.operators.query import preview
    p = preview(_customers(spark, sf_dir), ["customer_id"], n=100)
    return G.mask_frame(p, "viewer", pii_columns=["full_name", "email", "phone", "zip"])


SQL_PREVIEW_MASKED = f"""
SELECT * FROM ({SQL_MASK_CUSTOMER}) ORDER BY customer_id LIMIT 100
"""


def q_source_names(spark, sf_dir):
    """S11 name normalisation: a safe source table name for every distinct
    part name, and an ASCII tenant slug for every region name."""
    from tierline.functions.text import source_table_name, tenant_slug
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    r = table(spark, sf_dir, "region").select("r_name")
    return (p.select(F.lit("source").alias("kind"), F.col("p_name").alias("raw"),
                     source_table_name("p_name").alias("normalized"))
            .unionByName(r.select(F.lit("tenant").alias("kind"), F.col("r_name").alias("raw"),
                                  tenant_slug("r_name").alias("normalized"))))


SQL_SOURCE_NAMES = """
SELECT 'source' AS kind, p_name AS raw, regexp_replace(lower(p_name), '[^\\pL\\pN]', '_', 'g') AS normalized
FROM (SELECT DISTINCT p_name FROM part)
UNION ALL
SELECT 'tenant', r_name, regexp_replace(lower(r_name), '[^a-z0-9]', '_', 'g') FROM region
"""


QUERIES = {
    "preview_masked": (q_preview_masked, SQL_PREVIEW_MASKED),
    "source_names": (q_source_names, SQL_SOURCE_NAMES),
    "mask_customer": (q_mask_customer, SQL_MASK_CUSTOMER),
    "role_visible_entities": (q_role_visible_entities, SQL_ROLE_VISIBLE),
    "permission_matrix": (q_permission_matrix, SQL_PERMISSION_MATRIX),
    "scoped_query": (q_scoped_query, SQL_SCOPED_QUERY),
    "scoped_statements": (q_scoped_statements, SQL_SCOPED_STATEMENTS),
    "config_overlay": (q_config_overlay, SQL_CONFIG_OVERLAY),
    "secret_redaction": (q_secret_redaction, SQL_SECRET_REDACTION),
}
