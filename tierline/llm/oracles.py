"""DuckDB SQL for the queries that SQL can express, written from the
definitions and not from the operators' plans."""

from __future__ import annotations

from tierline.llm import license_scan

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def license_sql() -> str:
    split = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def words(t: str) -> str:
        return f"list_filter(regexp_split_to_array({t}, {split}), lambda x: x <> '')"

    def places(phrase: str) -> str:
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))
        return f"list_filter(range(len(w)), lambda i: {test})"

    rows = []
    for n, (text, label) in enumerate(license_scan.TEMPLATES):
        own = license_scan._template_words(text)
        need = license_scan._need(len(own), license_scan.THRESHOLD)
        rows.append(f"({n}, '{label}', {own!r}, {need})")
    at = [f"{places(p)} AS p{k}" for k, (p, _) in enumerate(license_scan.PHRASES)]
    marks = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(license_scan.PHRASES))
    every = "list_concat(list_concat(p0, p1), p2)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, {lower} AS t FROM documents),
w AS (SELECT row, doc_id, {words('t')} AS w FROM t),
p AS (SELECT row, doc_id, len(w) AS n_words, {', '.join(at)} FROM w),
template(id, label, own, need) AS (VALUES {', '.join(rows)}),
block AS (SELECT row, unnest(string_split(t, chr(10))) AS b FROM t),
held AS (SELECT row, list_distinct({words('b')}) AS own FROM block WHERE b <> ''),
hit AS (
  SELECT row, label, len(list_intersect(held.own, template.own)) / len(template.own) AS part
  FROM held JOIN template ON len(list_intersect(held.own, template.own)) >= need),
found AS (SELECT row, list(DISTINCT label) AS labels, max(part) AS part FROM hit GROUP BY row),
base AS (SELECT *, {every} AS pos, list_filter([{marks}], lambda x: x IS NOT NULL) AS own FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(pos)::BIGINT AS n_base, list_min(pos)::BIGINT AS first_word,
  list_max(pos)::BIGINT AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(own, coalesce(labels, [])))), ',') AS labels,
  CASE WHEN len(pos) > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
FROM base LEFT JOIN found USING (row)
"""


REPEATS = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
place AS (
  SELECT row, unnest(range(len(w))) AS pos, unnest(w) AS word FROM t),
start AS (
  SELECT row, unnest(range(len(w) - 34)) AS pos, w FROM t WHERE len(w) >= 35),
windows AS (SELECT row, pos, md5(array_to_string(w[pos + 1:pos + 35], ' ')) AS h FROM start),
again AS (SELECT row, pos FROM (SELECT row, pos, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
cover AS (
  SELECT place.row, place.pos, word,
    max(again.pos) OVER (PARTITION BY place.row ORDER BY place.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM place LEFT JOIN again ON place.row = again.row AND place.pos = again.pos),
kept AS (
  SELECT row, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM cover GROUP BY row)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (row)
"""

JACCARD = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS row, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))) END AS s
  FROM t),
held AS (SELECT row, len(s) AS n, unnest(s) AS g FROM s),
pair AS (
  SELECT a.row AS x, b.row AS y, count(*) AS i, any_value(a.n) AS n, any_value(b.n) AS m
  FROM held a JOIN held b ON a.g = b.g AND a.row < b.row GROUP BY a.row, b.row),
link AS (SELECT x, y FROM pair WHERE 100 * i >= 85 * (n + m - i)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(row, other) AS (
  SELECT row, row FROM s
  UNION
  SELECT reach.row, edge.y FROM reach JOIN edge ON reach.other = edge.x),
least AS (SELECT reach.row, min(s.doc_id) AS component_id FROM reach JOIN s ON reach.other = s.row GROUP BY reach.row)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN least USING (row)
"""

_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
    lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""

PREFIX_TRIE = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
u AS (
  SELECT conv_id, row_number() OVER own AS depth, strlen(text) AS bytes,
    string_agg(md5(length(role) || ':' || role || text), ' ') OVER own AS key
  FROM s WINDOW own AS (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (
  SELECT conv_id, depth, bytes, key FROM u
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
last AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
node AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY key, depth),
parent AS (
  SELECT node.key, node.depth, above.key AS above, up.conv_id AS parent_conv_id
  FROM node JOIN p AS above ON above.conv_id = node.conv_id AND above.depth = node.depth - 1
  JOIN node AS up ON up.key = above.key AND up.depth = above.depth),
child AS (SELECT above AS key, depth - 1 AS depth, count(*) AS n_children FROM parent GROUP BY above, depth),
own AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, parent_conv_id
  FROM node LEFT JOIN child USING (key, depth) LEFT JOIN parent USING (key, depth)),
below AS (
  SELECT p.key, p.depth, count(*) FILTER (own.n_children = 0) AS n_leaves, sum((own.n_convs - 1) * own.bytes) AS saved
  FROM own JOIN p ON p.conv_id = own.conv_id AND p.depth <= own.depth GROUP BY p.key, p.depth),
ends AS (
  SELECT p.key, p.depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM p JOIN last USING (conv_id) WHERE depth = len GROUP BY p.key, p.depth)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN below USING (key, depth) LEFT JOIN ends USING (key, depth)
"""
