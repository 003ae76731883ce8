"""Paged API landing (S4-S10), re-aimed: the input is a table of fetched page
bodies ``(pull_id, page, url, link_header, body)``; which pages a pull would
have landed is decided over a slim per-page frame, then the records of the
kept pages are exploded and enveloped.

Offset and cursor pulls are in page order, from the smallest page number of
the pull (0- or 1-based); a gap ends the pull.  Link-header and next-URL pulls
follow the URLs.  ``max_pages`` and ``max_records`` are the caller's bounds of a
pull (None: no bound); ``pull_report`` says what they cut.  With a page bound
the slim frame is cut to that many pages before the per-pull window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierline.functions.jsonx import dotted_path

# Usual bounds of a pull, for callers that want them.  Without a
# bound named, none holds.
MAX_PAGES = 100
MAX_RECORDS = 50_000
LINK_NEXT = r'<([^>]+)>;\s*rel="next"'


def resolve_path(body: Column, path: str) -> Column:
    """S4 dotted path (leading ``$.`` stripped), missing -> NULL, as VARIANT."""
    v = F.try_parse_json(body)
    if not path:
        return v
    if "'" in path:                       # no path can name such a key: step by step
        for part in (path[2:] if path.startswith("$.") else path).split("."):
            v = F.try_variant_get(v, "$", "map<string,variant>")[part]
        return v
    return F.try_variant_get(v, dotted_path(path), "variant")


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return F.when(v.isNull() | (s == "VOID"), "null").when(s.startswith("ARRAY"), "array") \
        .when(s.startswith("OBJECT"), "object").otherwise("scalar")


def page_records(pages: DataFrame, json_path: str = "", single: bool = False) -> DataFrame:
    """Records of each page as ``array<variant>`` plus their count.

    Paged rule: a list is the records, any other truthy value is one record,
    nothing is no record.  Single-page rule (S5): a dict is one record, a
    non-list non-dict means the whole body is the record."""
    v = resolve_path(F.col("body"), json_path)
    arr = F.try_variant_get(v, "$", "array<variant>")
    k = _kind(v)
    whole = F.array(F.try_parse_json(F.col("body")))
    if single:
        recs = F.when(k == "array", arr).when(k == "object", F.array(v)).otherwise(whole)
    else:
        recs = F.when(k == "array", arr).when(truthy(v), F.array(v)) \
            .otherwise(F.array().cast("array<variant>"))
    return pages.withColumn("_recs", recs).withColumn("_n", F.size("_recs"))


def truthy(v: Column) -> Column:
    """JSON truthiness of a VARIANT: null, false, 0, "", [] and {} are false."""
    k = _kind(v)
    j = F.to_json(v)
    return F.coalesce((k != "null") & ~j.isin('""', "0", "0.0", "-0.0", "false", "[]", "{}"), F.lit(False))


def _truthy_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _next_link(strategy: str, next_url_path: str, base_url: str) -> Column:
    if strategy == "link_header":
        return F.regexp_extract(F.coalesce(F.col("link_header"), F.lit("")), LINK_NEXT, 1)
    nv = resolve_path(F.col("body"), next_url_path)
    is_str = F.schema_of_variant(nv) == "STRING"
    raw = F.when(is_str, F.try_variant_get(nv, "$", "string"))
    return F.when(raw.startswith("/") & F.lit(bool(base_url)),
                  F.concat(F.lit(base_url.rstrip("/")), raw)).otherwise(raw)


def _first_page(pages: DataFrame) -> DataFrame:
    return pages.groupBy("pull_id").agg(F.min("page").alias("_first"))


def follow_links(pages: DataFrame, strategy: str, max_pages: int | None = None, next_url_path: str = "next",
                 base_url: str = "", max_records: int | None = None) -> DataFrame:
    """From each pull's first fetch, page -> the page of the same pull
    whose ``url`` is the next link.  Hops are found by pointer doubling
    (equi-joins on (pull, url); the number of rounds is the logarithm of the
    longest chain); a page's hop count is its fetch order, and a page met
    again ends the chain.  Returns (pull_id, page, hop); empty pages do not end
    a chain, the record bound applies in hop order."""
    from tierline.session import cut_lineage
    nodes = cut_lineage(pages.select("pull_id", "page", "url", "_n",
                                     _next_link(strategy, next_url_path, base_url).alias("_nx")))
    target = nodes.groupBy("pull_id", F.col("url").alias("_nx")).agg(F.min("page").alias("_to"))
    jump = cut_lineage(nodes.join(target, ["pull_id", "_nx"], "left")
                       .select("pull_id", "page", "_to", F.lit(1).cast("long").alias("_len")))
    reached = _first_page(nodes).select("pull_id", F.col("_first").alias("page"), F.lit(0).cast("long").alias("hop"))
    known, span = 0, 1
    while max_pages is None or span < 2 * max_pages:
        step = reached.join(jump, ["pull_id", "page"]).filter(F.col("_to").isNotNull()) \
            .select("pull_id", F.col("_to").alias("page"), (F.col("hop") + F.col("_len")).alias("hop"))
        reached = reached.unionByName(step).groupBy("pull_id", "page").agg(F.min("hop").alias("hop"))
        reached = cut_lineage(reached if max_pages is None else reached.filter(F.col("hop") < max_pages))
        now = reached.count()
        if now == known:
            break
        known, span = now, 2 * span
        a, b = jump.alias("a"), jump.alias("b")
        jump = cut_lineage(a.join(b, (F.col("a.pull_id") == F.col("b.pull_id")) & (F.col("a._to") == F.col("b.page")),
                                  "left")
                           .select(F.col("a.pull_id").alias("pull_id"), F.col("a.page").alias("page"),
                                   F.col("b._to").alias("_to"), (F.col("a._len") + F.col("b._len")).alias("_len")))
    if max_records is None:
        return reached
    chain = reached.join(nodes.select("pull_id", "page", "_n"), ["pull_id", "page"])
    w = Window.partitionBy("pull_id").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    chain = chain.withColumn("_rb", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return chain.filter(F.col("_rb") < max_records).select("pull_id", "page", "hop")


def kept_pages(pages: DataFrame, strategy: str, page_size: int = 100, max_pages: int | None = None,
               cursor_path: str = "meta.next_cursor", next_url_path: str = "next",
               base_url: str = "", max_records: int | None = None) -> DataFrame:
    """(pull_id, page) of the pages a pull lands, for ``offset``, ``cursor``,
    ``link_header`` or ``next_url``.  ``pages`` must carry ``_n`` (records)."""
    if strategy in ("link_header", "next_url"):
        return follow_links(pages, strategy, max_pages, next_url_path, base_url, max_records).select("pull_id", "page")
    land = F.col("_n") > 0
    if strategy == "offset":
        # an empty page is not landed; a short page is landed and stops
        stop_after = F.col("_n") < page_size
    elif strategy == "cursor":
        stop_after = ~truthy(resolve_path(F.col("body"), cursor_path)) | ~land
    else:
        raise ValueError(f"Unknown pagination strategy: {strategy}")
    slim = (pages.select("pull_id", "page", "_n", stop_after.alias("_stop"), land.alias("_land"))
            .join(_first_page(pages), "pull_id").withColumn("_hop", F.col("page") - F.col("_first")).drop("_first"))
    if max_pages is not None:
        slim = slim.filter(F.col("_hop") < max_pages)
    w = Window.partitionBy("pull_id").orderBy("page")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # page numbers are fetch order; a gap means the fetch chain broke
    contiguous = F.col("_hop") == F.row_number().over(w) - 1
    stopped_before = F.coalesce(F.max(F.col("_stop").cast("int")).over(before), F.lit(0)) == 1
    empty_before = F.coalesce(F.min(F.col("_land").cast("int")).over(before), F.lit(1)) == 0
    received_before = F.coalesce(F.sum("_n").over(before), F.lit(0))
    ok = contiguous & ~stopped_before & ~empty_before
    if max_records is not None:
        ok = ok & (received_before < max_records)
    # once a page fails, no later page is fetched
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    flagged = slim.withColumn("_ok", ok).withColumn("_ok_all", F.min(F.col("_ok").cast("int")).over(upto) == 1)
    return flagged.filter(F.col("_ok_all") & F.col("_land")).select("pull_id", "page")


def pull_report(pages: DataFrame, strategy: str, json_path: str = "", max_pages: int | None = None,
                max_records: int | None = None, **kw) -> DataFrame:
    """S10 per pull: pages given, pages landed, and whether a bound (not the
    strategy's own end) kept pages out."""
    slim = page_records(pages, json_path).drop("_recs")
    kept = kept_pages(slim, strategy, max_pages=max_pages, max_records=max_records, **kw)
    free = kept_pages(slim, strategy, max_pages=None, max_records=None, **kw)
    n = lambda df, name: df.groupBy("pull_id").agg(F.count(F.lit(1)).alias(name))
    out = n(pages, "pages_given").join(n(kept, "pages_landed"), "pull_id", "left").join(n(free, "_free"), "pull_id", "left")
    return out.select("pull_id", "pages_given", F.coalesce("pages_landed", F.lit(0)).alias("pages_landed"),
                      (F.coalesce("_free", F.lit(0)) > F.coalesce("pages_landed", F.lit(0))).alias("truncated"))


def land_pages(pages: DataFrame, strategy: str = "", json_path: str = "", **kw) -> DataFrame:
    """Records of the kept pages, one row each:
    ``pull_id, page, item_pos, url, record (JSON text)``; metadata is
    ``{"pulled_from": url, "page": page}`` (single page: ``pulled_from`` only).
    Bounds hold only where the caller names them; ``pull_report`` with the same
    ones says what they cut.
    """
    if not strategy:
        first = pages.join(_first_page(pages), "pull_id").filter(F.col("page") == F.col("_first")).drop("_first")
        recs = page_records(first, json_path, single=True)
        meta = F.to_json(F.struct(F.col("url").alias("pulled_from")))
    else:
        recs = page_records(pages, json_path)
        keep = kept_pages(recs.select("pull_id", "page", "url", "link_header", "body", "_n"),
                          strategy, **kw)
        recs = recs.join(keep, ["pull_id", "page"], "left_semi")
        meta = F.to_json(F.struct(F.col("url").alias("pulled_from"), F.col("page").alias("page")))
    out = recs.select("pull_id", "page", "url", meta.alias("metadata"),
                      F.posexplode("_recs").alias("item_pos", "_r"))
    return out.select("pull_id", "page", "item_pos", "url", "metadata",
                      F.to_json("_r").alias("record"))
