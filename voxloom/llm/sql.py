"""DuckDB statements of the corpus queries that SQL can express."""

from __future__ import annotations

from .op09_urls import RULES

WORD = r"[^\x20\x09-\x0D]+"

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

#: Groups of equal texts, straight from the definition.
EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

#: Every rule tried on every distinct (host, path).
URLS = f"""
WITH parsed AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM parsed),
hosts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM hosts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL)
SELECT page_id, hosts.host, hosts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM hosts LEFT JOIN best USING (host, path)
"""

#: Vectors of whole numbers.
_VECTORS = """vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

#: Every query against every other row.
TOP_PRODUCTS = f"""
WITH {_VECTORS}
SELECT q.vec_id AS query_id, (row_number() OVER best)::INTEGER AS rank, c.vec_id AS vec_id,
       list_inner_product(q.v, c.v)::BIGINT AS score
FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
WINDOW best AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id)
QUALIFY rank <= 5
"""

#: Every anchor against every other row, then positives against the rows of other labels.
NEGATIVES = f"""
WITH {_VECTORS},
moved AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM vectors WHERE label IS NOT NULL),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM moved a JOIN moved b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY rank <= 3
"""

#: Nodes as lists of turns, subtrees by joining every node to each list that it starts with.
TRIE = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
      lambda sum, byte: list_reduce(list_prepend(xor(sum, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.i, t.role, t.text
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
members AS (
  SELECT conv_id, coalesce(s, []) AS s FROM convs LEFT JOIN (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, i) AS s FROM rebuilt GROUP BY conv_id) USING (conv_id)),
paths AS (SELECT conv_id, d, s[1:d] AS key, len(s) = d AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM members)),
nodes AS (
  SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY key, d),
kids AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (
  SELECT key, depth, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(key[depth].text) END AS saved
  FROM nodes LEFT JOIN kids USING (key)),
totals AS (
  SELECT key[1:up] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM own) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, o.n_children, t.n_leaves, t.saved_tokens, n.ends_sha256
FROM nodes n JOIN own o USING (key) JOIN totals t USING (key)
LEFT JOIN nodes p ON n.depth > 0 AND p.key = n.key[1:n.depth - 1]
"""

#: The draw of the mix is the engine's own hash, so SQL has no say in it.
SQL = {"op5_top_products": TOP_PRODUCTS, "op6_exact_dedup": EXACT, "op9_url_filter": URLS, "op11_prefix_trie": TRIE,
       "op13_hard_negatives": NEGATIVES}
