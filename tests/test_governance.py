"""Roles, scoped queries and tenant isolation."""

import pytest
from pyspark.sql import functions as F

from tierline.operators import governance as G


def test_permission_matrix(spark):
    req = spark.createDataFrame([("viewer", "catalogue", "read", False), ("viewer", "catalogue", "write", False),
                                 ("engineer", "transform", "approve", False), ("analyst", "transform", "approve", False),
                                 ("nobody", "catalogue", "read", False), ("nobody", "user", "admin", True),
                                 ("admin", "user", "approve", False), (None, "catalogue", "read", False),
                                 (None, "catalogue", "write", False)],
                                "role string, resource string, action string, su boolean")
    got = [r.allowed for r in G.can(req, G.permission_matrix(spark), superuser_col="su").collect()]
    assert got == [True, False, True, False, False, True, False, True, False]


def test_role_layers():
    assert G.layers_for("analyst") == ["silver", "gold"]
    assert G.layers_for("viewer") == ["gold"] and G.layers_for("unknown") == ["gold"]
    assert G.layers_for("owner", entity_api=True) == ["silver", "gold"]


def test_scoped_query(spark):
    silver = spark.createDataFrame([(1, "a@b.com")], "id int, email string")
    gold = spark.createDataFrame([(1, 5)], "id int, n int")
    tables = {"silver.people": silver, "gold.counts": gold}
    out = G.run_query(spark, "SELECT email AS e FROM silver.people", "analyst", tables)
    assert out.first().e == "a***@b.com"          # masked before the query, alias does not help
    assert G.run_query(spark, "SELECT email FROM silver.people", "owner", tables).first().email == "a@b.com"
    with pytest.raises(G.QueryDenied):
        G.run_query(spark, "SELECT * FROM silver.people", "viewer", tables)
    with pytest.raises(G.QueryDenied):
        G.run_query(spark, "DROP TABLE x", "owner", tables)
    with pytest.raises(G.QueryDenied):
        G.run_query(spark, "SELECT * FROM gold.other", "owner", tables)
    assert G.run_query(spark, "WITH c AS (SELECT * FROM gold.counts) SELECT n FROM c", "viewer",
                       tables).first().n == 5


def test_tenant_isolation(spark):
    ents = spark.createDataFrame([("tenant-a", "orders"), ("tenant-b", "orders"), ("tenant-b", "users")],
                                 "tenant_id string, name string")
    assert [r.name for r in G.scoped(ents, "tenant-a").collect()] == ["orders"]
    assert G.scoped(ents, "tenant-c").count() == 0


def test_secret_redaction(spark):
    df = spark.createDataFrame([({"url": "u", "Token": "t", "page_size": "5", "x_api_key": "k"},)],
                               "cfg map<string,string>")
    r = df.select(G.redact_secrets("cfg").alias("r")).first().r
    assert r == {"url": "u", "Token": "***", "page_size": "5", "x_api_key": "***"}
    back = df.select(G.drop_redacted(G.redact_secrets("cfg")).alias("c")).first().c
    assert back == {"url": "u", "page_size": "5"}


def test_scoped_query_reaches_nothing_else(spark, tmpdir_path):
    silver = spark.createDataFrame([(1, "a@b.com")], "id int, email string")
    gold = spark.createDataFrame([(1, 5), (2, 6)], "id int, n int")
    tables = {"silver.people": silver, "gold.counts": gold}
    gold.write.mode("overwrite").parquet(f"{tmpdir_path}/p")
    silver.createOrReplaceTempView("session_view")
    run = lambda sql, role="viewer": G.run_query(spark, sql, role, tables)
    for sql in (f"SELECT * FROM parquet.`{tmpdir_path}/p`", "SELECT * FROM session_view", "SELECT * FROM default.t",
                "WITH x AS (SELECT * FROM gold.counts) INSERT INTO tgt SELECT * FROM x", "INSERT INTO gold.counts SELECT 1, 2",
                "SELECT * FROM gold.counts WHERE n IN (SELECT id FROM silver.people)", "SELECT (SELECT max(id) FROM session_view) AS m",
                "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SHOW TABLES", "SELECT * FROM range(5)", "not sql at all",
                "WITH a AS (SELECT * FROM silver.people) SELECT * FROM a", "CREATE TABLE x AS SELECT * FROM gold.counts", "SELECT 1; DROP TABLE x",
                "WITH a AS (SELECT * FROM b), b AS (SELECT * FROM gold.counts) SELECT * FROM a", "SELECT * FROM gold.counts.x"):
        with pytest.raises(G.QueryDenied):
            run(sql).collect()
    assert run("SELECT 'gold.counts' AS s, counts.n FROM gold.counts WHERE '{x}' = '{x}' ORDER BY n").first().asDict() == {"s": "gold.counts", "n": 5}
    assert run("SELECT c.n FROM GOLD.counts c JOIN gold.counts AS d ON c.id = d.id WHERE c.id IN (SELECT id FROM gold.counts WHERE n = 6)").first().n == 6
    assert run("WITH counts AS (SELECT n FROM gold.counts), b AS (SELECT n + 1 AS n FROM counts) SELECT sum(n) AS s FROM b").first().s == 13
    assert run("SELECT count(*) AS c FROM gold.counts UNION ALL SELECT 7").count() == 2


def test_scoped_query_calls_only_granted_functions(spark):
    gold = spark.createDataFrame([(1, 5), (2, 6)], "id int, n int")
    run = lambda sql, role="owner": G.run_query(spark, sql, role, {"gold.counts": gold})
    spark.udf.register("own_function", lambda x: x)
    home = "'java.lang.System', 'getProperty', 'user.home'"
    for call in (f"`reflect`({home})", f"reflect /**/ ({home})", f"reflect\n--x\n({home})", f"`java_method`({home})", f"Try_Reflect({home})",
                 f"builtin.reflect({home})", f"IDENTIFIER('reflect')({home})", f"IDENTIFIER('ref' || 'lect')({home})", "own_function(n)", "nothing(n)",
                 "spark_catalog.default.f(n)", "input_file_name()", "current_user()", "version()", "raise_error('x')"):
        for sql in (f"SELECT {call} AS x FROM gold.counts", f"SELECT n FROM gold.counts WHERE {call} IS NOT NULL",
                    f"SELECT n FROM gold.counts ORDER BY {call}", f"SELECT max({call}) AS x FROM gold.counts GROUP BY {call}",
                    f"SELECT sum(n) OVER w AS s FROM gold.counts WINDOW w AS (PARTITION BY {call})", f"SELECT * FROM VALUES ({call}) AS t(a)",
                    f"WITH c AS (SELECT {call} AS x) SELECT * FROM c", f"SELECT CASE WHEN n > 1 THEN {call} ELSE 'a' END AS x FROM gold.counts",
                    f"SELECT n FROM gold.counts WHERE EXISTS (SELECT {call})", f"SELECT transform(array(n), x -> {call}) AS x FROM gold.counts",
                    f"SELECT e FROM gold.counts LATERAL VIEW explode(array({call})) t AS e", f"SELECT n FROM gold.counts LIMIT length({call})",
                    f"SELECT * FROM gold.counts PIVOT (max({call}) FOR n IN (5, 6))", f"SELECT a.n FROM gold.counts a JOIN gold.counts b ON a.n = {call}"):
            with pytest.raises(G.QueryDenied):
                run(sql)
    with pytest.raises(G.QueryDenied):
        run("SELECT e FROM gold.counts LATERAL VIEW own_function(n) t AS e")
    for sql, want in (("SELECT 'reflect(x)' AS s, n FROM gold.counts WHERE n = 6", "reflect(x)"), ("SELECT upper('a') AS s", "A"),
                      ("SELECT `reflect` AS s FROM (SELECT n AS reflect FROM gold.counts WHERE n = 5)", 5),
                      ("SELECT date_format(DATE'2024-01-02', 'yyyy') AS s", "2024"), ("SELECT coalesce(nullif(n, 6), -1) AS s FROM gold.counts WHERE id = 2", -1),
                      ("SELECT first(e) AS s FROM gold.counts LATERAL VIEW explode(array(n)) t AS e WHERE n = 5", 5),
                      ("SELECT row_number() OVER (ORDER BY n) AS s FROM gold.counts ORDER BY 1 DESC LIMIT 1", 2),
                      ("SELECT get_json_object(to_json(named_struct('a', n)), '$.a') AS s FROM gold.counts WHERE n = 5", "5"),
                      ("SELECT percentile_approx(n, 0.5) AS s FROM gold.counts", 5), ("SELECT typeof(n) AS s FROM gold.counts LIMIT 1", "int"),
                      ("SELECT count(*) FILTER (WHERE n > 5) AS s FROM gold.counts", 1), ("SELECT year(to_timestamp('2024-05-01')) AS s", 2024)):
        assert run(sql).first().s == want
