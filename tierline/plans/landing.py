"""Landing plans: CSV (S2, P7), NDJSON (S3), run accounting (S12) and paged
pulls (S4-S10).  Files are written by Spark below the shared scratch folder
and read back, so the readers are exercised on real files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierline.functions import jsonx
from tierline.operators.flatten import flatten_select
from tierline.operators.infer import infer_fields
from tierline.plans.common import BATCH, INGESTED_AT, TENANT, dealt, r2, table, ts_text
from tierline.session import scratch_dir
from tierline.sources import pages as pg
from tierline.sources.landing import land_csv, land_json

# ------------------------------------------------------------------ S2 CSV


def _customer_csv(spark, sf_dir):
    c = dealt(table(spark, sf_dir, "customer"))
    out = c.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name",
                   F.col("c_acctbal").cast("string").alias("c_acctbal"), "c_mktsegment",
                   F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.lit("ok")).alias("note"))
    path = scratch_dir(spark, "csv-customer")
    out.write.option("header", True).csv(path)
    return land_csv(spark, path, "Customer Upload", TENANT, BATCH, INGESTED_AT)


def q_csv_landing(spark, sf_dir):
    land = _customer_csv(spark, sf_dir)
    fields = [("c_custkey", "string"), ("c_name", "string"), ("c_acctbal", "string"),
              ("c_mktsegment", "string"), ("note", "string")]
    return flatten_select(land.bronze, fields, "c_custkey")


SQL_CSV = """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
       c_mktsegment, CASE WHEN c_acctbal < 0 THEN '' ELSE 'ok' END AS note
FROM customer
"""


def q_csv_infer(spark, sf_dir):
    """P7 inference over the CSV landing: every value is text."""
    land = _customer_csv(spark, sf_dir)
    b = land.bronze.withColumn("_pos", F.get_json_object("payload", "$.c_custkey").cast("long"))
    f = infer_fields(b, "_pos")
    return f.select("name", "ordinal", "data_type", "nullable", "is_pii", "is_pk", "n_present")


SQL_CSV_INFER = """
SELECT * FROM (VALUES
 ('c_custkey', 0, 'int', false, false, false, (SELECT COUNT(*) FROM customer)),
 ('c_name', 1, 'string', false, false, false, (SELECT COUNT(*) FROM customer)),
 ('c_acctbal', 2, 'float', false, false, false, (SELECT COUNT(*) FROM customer)),
 ('c_mktsegment', 3, 'string', false, false, false, (SELECT COUNT(*) FROM customer)),
 ('note', 4, 'string', false, false, false, (SELECT COUNT(*) FROM customer))
) AS v(name, ordinal, data_type, nullable, is_pii, is_pk, n_present)
"""



def _text_files(df, path, parts):
    """Lines of ``df`` (part, pos, line) as one text file per part."""
    for part in parts:
        (df.filter(F.col("part") == part).coalesce(1).sortWithinPartitions("pos")
         .select("line").write.text(f"{path}/part={part}"))


def _landing_summary(land):
    """Payloads and rejects as rows, each with the run's counts and status."""
    rows = (land.bronze.select(F.lit("landed").alias("outcome"), F.col("payload").alias("content"))
            .unionByName(land.rejects.select(F.lit("rejected").alias("outcome"), F.col("raw").alias("content"))))
    return rows.crossJoin(land.run.select("records_in", "records_out", "records_rejected", "status"))   # one row


def q_csv_landing_ragged(spark, sf_dir):
    """S2 two files of customers: one with quotes, quoted newlines, short and
    over-long rows, one with its columns in another order."""
    k, name = F.col("c_custkey"), F.col("c_name")
    rows = table(spark, sf_dir, "customer").select(
        (k % 2).alias("part"), k.alias("pos"),
        F.when(k % 2 == 1, F.concat_ws(",", k.cast("string"), "c_mktsegment", name))
        .when(k % 10 == 2, k.cast("string"))
        .when(k % 10 == 4, F.concat_ws(",", k.cast("string"), name, "c_mktsegment", F.lit("beyond")))
        .when(k % 10 == 6, F.concat(k.cast("string"), F.lit(',"say ""'), name, F.lit('""\nagain",'), "c_mktsegment"))
        .otherwise(F.concat_ws(",", k.cast("string"), name, F.lit(""))).alias("line"))
    head = spark.createDataFrame([(0, -1, "key,name,segment"), (1, -1, "key,segment,name")], "part int, pos long, line string")
    path = scratch_dir(spark, "csv-ragged")
    _text_files(head.unionByName(rows), path, (0, 1))
    return _landing_summary(land_csv(spark, path, "Ragged Upload", TENANT, BATCH, INGESTED_AT))


SQL_CSV_RAGGED = """
WITH r AS (
  SELECT CASE WHEN c_custkey % 2 = 0 AND c_custkey % 10 = 4 THEN 'rejected' ELSE 'landed' END AS outcome,
         CASE WHEN c_custkey % 2 = 1 THEN '{"key":"' || c_custkey || '","segment":"' || c_mktsegment || '","name":"' || c_name || '"}'
              WHEN c_custkey % 10 = 2 THEN '{"key":"' || c_custkey || '","name":"","segment":""}'
              WHEN c_custkey % 10 = 4 THEN c_custkey || ',' || c_name || ',' || c_mktsegment || ',beyond'
              WHEN c_custkey % 10 = 6 THEN '{"key":"' || c_custkey || '","name":"say \\"' || c_name || '\\"\\nagain","segment":"' || c_mktsegment || '"}'
              ELSE '{"key":"' || c_custkey || '","name":"' || c_name || '","segment":""}' END AS content
  FROM customer)
SELECT outcome, content, (SELECT COUNT(*) FROM r) AS records_in, (SELECT COUNT(*) FROM r WHERE outcome = 'landed') AS records_out,
       (SELECT COUNT(*) FROM r WHERE outcome = 'rejected') AS records_rejected, 'partial' AS status
FROM r
"""



def q_csv_landing_blocks(spark, sf_dir):
    """S2 all line items as one file: a header over two lines, and records
    with quoted newlines, commas, doubled and lone quotes, so that where a
    split starts says nothing about quotes.  Every ninth row is too long."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("part"), (k * 10 + n).alias("pos"), F.concat_ws(
        ",", k.cast("string"), n.cast("string"),
        F.when(k % 4 == 0, F.lit('"two\nlines, ""one"" cell\n"')).when(k % 4 == 1, F.lit('a "lone" quote')).otherwise(F.lit('","')),
        F.when((k + n) % 9 == 0, F.lit("last,beyond")).otherwise(F.lit('"last"'))).alias("line"))
    head = spark.createDataFrame([(0, -1, '"order\nkey",line,note,end')], "part int, pos long, line string")
    path = scratch_dir(spark, "csv-blocks")
    _text_files(head.unionByName(rows), path, (0,))
    return _landing_summary(land_csv(spark, path, "Blocks Upload", TENANT, BATCH, INGESTED_AT))


SQL_CSV_BLOCKS = r"""
WITH r AS (
  SELECT CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN 'rejected' ELSE 'landed' END AS outcome,
         CASE WHEN (l_orderkey + l_linenumber) % 9 = 0
              THEN l_orderkey || ',' || l_linenumber || ',' ||
                   CASE l_orderkey % 4 WHEN 0 THEN '"two' || chr(10) || 'lines, ""one"" cell' || chr(10) || '"'
                        WHEN 1 THEN 'a "lone" quote' ELSE '","' END || ',last,beyond'
              ELSE '{"order\nkey":"' || l_orderkey || '","line":"' || l_linenumber || '","note":"' ||
                   CASE l_orderkey % 4 WHEN 0 THEN 'two\nlines, \"one\" cell\n' WHEN 1 THEN 'a \"lone\" quote' ELSE ',' END ||
                   '","end":"last"}' END AS content
  FROM lineitem)
SELECT outcome, content, (SELECT COUNT(*) FROM r) AS records_in, (SELECT COUNT(*) FROM r WHERE outcome = 'landed') AS records_out,
       (SELECT COUNT(*) FROM r WHERE outcome = 'rejected') AS records_rejected, 'partial' AS status
FROM r
"""

# --------------------------------------------------------------- S3 NDJSON


def q_ndjson_landing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = scratch_dir(spark, "ndjson-orders")
    o.select(jsonx.row_json().alias("value")).write.text(path)
    land = land_json(spark, path, "orders", TENANT, BATCH, INGESTED_AT)
    fields = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"),
              ("o_totalprice", "float"), ("o_orderdate", "timestamp")]
    rows = flatten_select(land.bronze, fields, "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", r2("o_totalprice").alias("o_totalprice"),
                       ts_text("o_orderdate").alias("o_orderdate"))


SQL_NDJSON = """
SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice, 2) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate
FROM orders
"""



def q_json_landing_mixed(spark, sf_dir):
    """S3 orders as a file of lines (key order, ``1.0``, repeated keys and
    trailing text), a file that is one array, and a one-line file that is no
    JSON."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    record = F.concat(F.lit('{"z":'), price, F.lit('.0,"a":'), k.cast("string"), F.lit("}"))
    lines = o.select((k % 2).cast("int").alias("part"), k.alias("pos"),
                     F.when(k % 2 == 1, F.concat(F.lit(","), record))
                     .when(k % 10 == 4, F.concat(record, F.lit(" and more")))
                     .when(k % 10 == 8, F.concat(F.lit('{"k":1,"k":'), k.cast("string"), F.lit("}")))
                     .otherwise(record).alias("line"))
    frame = spark.createDataFrame([(1, -1, "[0"), (1, 2 ** 62, "]"), (2, 0, "no json")], "part int, pos long, line string")
    path = scratch_dir(spark, "json-mixed")
    _text_files(lines.unionByName(frame), path, (0, 1, 2))
    return _landing_summary(land_json(spark, path, "mixed", TENANT, BATCH, INGESTED_AT))


def q_json_landing_blocks(spark, sf_dir):
    """S3 all line items as one array in one line, with brackets, commas and
    escaped quotes in its texts, and all orders as a file of lines whose first
    line is an open bracket."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    element = F.concat(F.lit('{"k":'), F.col("l_orderkey").cast("string"), F.lit(',"n":['), F.col("l_linenumber").cast("string"),
                       F.lit(',0],"t":"]},[{ \\"a, b\\"","f":"'), F.col("l_returnflag"), F.lit('"}'))
    path = scratch_dir(spark, "json-blocks")
    (li.select(element.alias("e"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")).coalesce(1).sortWithinPartitions("pos")
     .select(F.when(F.monotonically_increasing_id() == 0, F.concat(F.lit("["), "e")).otherwise(F.concat(F.lit(","), "e")).alias("e"))
     .unionByName(spark.range(1).select(F.lit("]").alias("e"))).coalesce(1).write.option("lineSep", " ").text(f"{path}/part=1"))
    lines = o.select(F.lit(0).alias("part"), F.col("o_orderkey").alias("pos"),
                     F.concat(F.lit('{"o":'), F.col("o_orderkey").cast("string"), F.lit(',"s":"'), F.col("o_orderstatus"), F.lit('"}')).alias("line"))
    head = spark.createDataFrame([(0, -1, "[")], "part int, pos long, line string")
    _text_files(head.unionByName(lines), path, (0,))
    return _landing_summary(land_json(spark, path, "blocks", TENANT, BATCH, INGESTED_AT))


SQL_JSON_BLOCKS = """
WITH r AS (
  SELECT 'landed' AS outcome, '{"k":' || l_orderkey || ',"n":[' || l_linenumber || ',0],"t":"]},[{ \\"a, b\\"","f":"' || l_returnflag || '"}' AS content
  FROM lineitem
  UNION ALL SELECT 'landed', '{"o":' || o_orderkey || ',"s":"' || o_orderstatus || '"}' FROM orders
  UNION ALL SELECT 'rejected', '[')
SELECT outcome, content, (SELECT COUNT(*) FROM r) AS records_in, (SELECT COUNT(*) FROM r WHERE outcome = 'landed') AS records_out,
       (SELECT COUNT(*) FROM r WHERE outcome = 'rejected') AS records_rejected, 'partial' AS status
FROM r
"""

SQL_JSON_MIXED = """
WITH o AS (SELECT o_orderkey AS k, '{"z":' || CAST(floor(o_totalprice) AS BIGINT) || '.0,"a":' || o_orderkey || '}' AS record FROM orders),
r AS (
  SELECT CASE WHEN k % 2 = 0 AND k % 10 = 4 THEN 'rejected' ELSE 'landed' END AS outcome,
         CASE WHEN k % 2 = 1 THEN record WHEN k % 10 = 4 THEN record || ' and more'
              WHEN k % 10 = 8 THEN '{"k":1,"k":' || k || '}' ELSE record END AS content FROM o
  UNION ALL SELECT 'rejected', 'no json' UNION ALL SELECT 'landed', '0')
SELECT outcome, content, (SELECT COUNT(*) FROM r) AS records_in, (SELECT COUNT(*) FROM r WHERE outcome = 'landed') AS records_out,
       (SELECT COUNT(*) FROM r WHERE outcome = 'rejected') AS records_rejected, 'partial' AS status
FROM r
"""

# ------------------------------------------------------------- S12 runs


def landing_runs(flags, batch_col: str):
    """S12 per batch: records_in / out / rejected, status."""
    g = flags.groupBy(batch_col).agg(F.count(F.lit(1)).alias("records_in"),
                                     F.count_if(F.col("_ok")).alias("records_out"))
    return g.select(batch_col, "records_in", "records_out",
                    (F.col("records_in") - F.col("records_out")).alias("records_rejected"),
                    F.when(F.col("records_in") == F.col("records_out"), "success")
                    .when(F.col("records_out") > 0, "partial").otherwise("failed").alias("status"))


def q_landing_runs(spark, sf_dir):
    """Events landed in daily batches; an ``error`` event is a rejected record."""
    e = table(spark, sf_dir, "events")
    flags = e.select(F.to_date("ts").cast("string").alias("batch"),
                     (F.col("event_type") != "error").alias("_ok"))
    return landing_runs(flags, "batch")


SQL_LANDING_RUNS = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS batch, COUNT(*) AS records_in,
       COUNT(*) FILTER (WHERE event_type <> 'error') AS records_out,
       COUNT(*) FILTER (WHERE event_type = 'error') AS records_rejected,
       CASE WHEN COUNT(*) FILTER (WHERE event_type = 'error') = 0 THEN 'success'
            WHEN COUNT(*) FILTER (WHERE event_type <> 'error') > 0 THEN 'partial' ELSE 'failed' END AS status
FROM events GROUP BY 1
"""

# ---------------------------------------------------------- S4-S10 pages
PAGE_SIZE = 10
BASE = "https://api.example.com"
KEYS_PER_PAGE = 250      # a page holds the brand's parts of one key range (about 10 at any scale)


def fetched_pages(spark, sf_dir):
    """Fetched page bodies of one pull per brand; page = part-key range, so a
    page holds a bounded number of records at any scale.  The cursor ends on
    the last page; the Link header is left out after page 2 for odd brands;
    ``next`` is a number (ends the chain) at page 1 for brands divisible by 3."""
    p = table(spark, sf_dir, "part")
    p = p.select(F.col("p_brand").alias("pull_id"),
                 F.floor(F.col("p_partkey") / KEYS_PER_PAGE).cast("int").alias("page"),
                 "p_partkey", "p_name", "p_retailprice")
    # Re-nest the records of each page (at most KEYS_PER_PAGE records)
    items = p.groupBy("pull_id", "page").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_retailprice"))).alias("items"))
    # one row per pull, broadcast (the number of pulls, not of records)
    last = items.groupBy("pull_id").agg(F.max("page").alias("_last"))
    items = items.join(F.broadcast(last), "pull_id")
    brand_no = F.regexp_extract("pull_id", r"(\d+)$", 1).cast("int")
    url_of = lambda pgc: F.concat(F.lit(BASE), F.lit("/parts/"), brand_no.cast("string"),
                                  F.lit("?page="), pgc.cast("string"))
    rel_of = lambda pgc: F.concat(F.lit("/parts/"), brand_no.cast("string"),
                                  F.lit("?page="), pgc.cast("string"))
    has_next = F.col("page") < F.col("_last")
    cursor = F.when(has_next, F.concat(F.lit("c"), (F.col("page") + 1).cast("string")))
    link = F.when(has_next & ~((brand_no % 2 == 1) & (F.col("page") >= 2)),
                  F.concat(F.lit("<"), url_of(F.col("page") + 1), F.lit('>; rel="next"')))
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))  # noqa: E731  (plain ASCII text)
    nxt = F.when(has_next & (brand_no % 3 == 0) & (F.col("page") == 1), F.lit("7")) \
        .when(has_next, q(rel_of(F.col("page") + 1)))
    body = F.concat(F.lit('{"data":{"items":'), F.to_json("items"), F.lit('},"meta":{"next_cursor":'),
                    F.coalesce(q(cursor), F.lit("null")), F.lit('},"next":'),
                    F.coalesce(nxt, F.lit("null")), F.lit("}"))
    return items.select("pull_id", "page", url_of(F.col("page")).alias("url"),
                        link.alias("link_header"), body.alias("body"))


def _landed(landed):
    return landed.select("pull_id", "page", "item_pos",
                         F.get_json_object("record", "$.p_partkey").cast("long").alias("p_partkey"))


def q_pages_offset(spark, sf_dir):
    return _landed(pg.land_pages(fetched_pages(spark, sf_dir), "offset", "data.items",
                                 page_size=PAGE_SIZE, max_pages=100))


def q_pages_cursor(spark, sf_dir):
    return _landed(pg.land_pages(fetched_pages(spark, sf_dir), "cursor", "data.items", max_pages=4))


def q_pages_link(spark, sf_dir):
    return _landed(pg.land_pages(fetched_pages(spark, sf_dir), "link_header", "data.items"))


def q_pages_next(spark, sf_dir):
    return _landed(pg.land_pages(fetched_pages(spark, sf_dir), "next_url", "data.items",
                                 base_url=BASE))


def q_pages_single(spark, sf_dir):
    return _landed(pg.land_pages(fetched_pages(spark, sf_dir), "", "data.items"))


_PAGES_CTE = """
WITH p AS (SELECT p_brand AS pull_id, CAST(floor(p_partkey / 250) AS INTEGER) AS page, p_partkey,
                  CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS brand_no
           FROM part),
pp AS (SELECT pull_id, page, brand_no, COUNT(*) AS n FROM p GROUP BY ALL),
pl AS (SELECT *, MAX(page) OVER (PARTITION BY pull_id) AS last_page,
              ROW_NUMBER() OVER (PARTITION BY pull_id ORDER BY page) - 1 AS rn FROM pp),
items AS (SELECT pull_id, page, p_partkey,
                 ROW_NUMBER() OVER (PARTITION BY pull_id, page ORDER BY p_partkey) - 1 AS item_pos FROM p)
"""


def _pages_sql(keep_pred: str) -> str:
    return _PAGES_CTE + f"""
, flags AS (SELECT *, {keep_pred} AS ok FROM pl),
kept AS (SELECT pull_id, page FROM flags f
         WHERE ok AND NOT EXISTS (SELECT 1 FROM flags g WHERE g.pull_id = f.pull_id AND g.page < f.page AND NOT g.ok))
SELECT i.pull_id, i.page, i.item_pos, i.p_partkey FROM items i JOIN kept USING (pull_id, page)
"""


# offset: contiguous, no earlier short page, this page non-empty
SQL_PAGES_OFFSET = _pages_sql(
    "page = rn AND page < 100 AND COALESCE((SELECT MIN(n) FROM pl q WHERE q.pull_id = pl.pull_id "
    f"AND q.page < pl.page), 1000000) >= {PAGE_SIZE}")
# cursor: every page but the last has a cursor; max 4 pages
SQL_PAGES_CURSOR = _pages_sql("page = rn AND page < 4")
# link: odd brands lose the link after page 2, so pages 0..2 (+3 when linked)
SQL_PAGES_LINK = _pages_sql("page = rn AND NOT (brand_no % 2 = 1 AND page > 2)")
# next: brands divisible by 3 have a non-string next at page 1, so pages 0..1
SQL_PAGES_NEXT = _pages_sql("page = rn AND NOT (brand_no % 3 = 0 AND page > 1)")
SQL_PAGES_SINGLE = _PAGES_CTE + """
SELECT pull_id, page, item_pos, p_partkey FROM items WHERE page = 0
"""

QUERIES = {
    "csv_landing": (q_csv_landing, SQL_CSV),
    "csv_infer_fields": (q_csv_infer, SQL_CSV_INFER),
    "csv_landing_ragged": (q_csv_landing_ragged, SQL_CSV_RAGGED),
    "csv_landing_blocks": (q_csv_landing_blocks, SQL_CSV_BLOCKS),
    "json_landing_blocks": (q_json_landing_blocks, SQL_JSON_BLOCKS),
    "json_landing_mixed": (q_json_landing_mixed, SQL_JSON_MIXED),
    "ndjson_landing": (q_ndjson_landing, SQL_NDJSON),
    "landing_runs": (q_landing_runs, SQL_LANDING_RUNS),
    "pages_offset": (q_pages_offset, SQL_PAGES_OFFSET),
    "pages_cursor": (q_pages_cursor, SQL_PAGES_CURSOR),
    "pages_link": (q_pages_link, SQL_PAGES_LINK),
    "pages_next": (q_pages_next, SQL_PAGES_NEXT),
    "pages_single": (q_pages_single, SQL_PAGES_SINGLE),
}
