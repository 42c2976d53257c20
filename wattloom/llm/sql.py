"""DuckDB SQL of the text queries that SQL can express."""

from __future__ import annotations

from wattloom.llm.urls import HOST_RULES, PATTERNS

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _unnested(key: str, rows: str, n: str | int) -> str:
    """Windows of n words of each row, with their first word's number."""
    starts = f"range(1, len(ws) - {n} + 2)"
    return f"""SELECT {key}, unnest({starts}) AS p, unnest(list_transform({starts}, lambda p: array_to_string(ws[p : p + {n} - 1], ' '))) AS w
      FROM {rows} WHERE len(ws) >= {n}"""


WINNOWING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{_ALNUM}') AS ws FROM documents),
  i AS (SELECT item_id, regexp_extract_all({_lower("text")}, '{_ALNUM}') AS ws FROM benchmark),
  iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS w
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
  sizes AS (SELECT DISTINCT n FROM iw),
  dw AS ({_unnested("doc_id, n", "d, sizes", "n")}),
  hits AS (SELECT doc_id, n, p, item_id FROM dw JOIN iw USING (n, w)),
  words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hits)) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '{_WORD}') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 5, 0) + 2),
    lambda p: array_to_string(ws[p : p + 4], ' '))) AS w FROM d WHERE len(ws) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
  steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, steps.b FROM reach JOIN steps ON reach.b = steps.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


def _windows(n: int) -> str:
    """Positions of words in windows of n words that occur twice or more in their document."""
    return f"""SELECT doc_id, count(DISTINCT q) AS n, max(c) AS c FROM (SELECT doc_id, c, unnest(range(p, p + {n})) AS q FROM
      (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w) AS c FROM ({_unnested("doc_id", "d", n)})) WHERE c > 1) GROUP BY doc_id"""


REPETITION = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
  five AS ({_windows(5)}), ten AS ({_windows(10)}), hundred AS ({_windows(101)}),
  lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)
    WHERE regexp_matches(x, '{_WORD}') GROUP BY doc_id),
  x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      coalesce(lines.n, 0) AS n_dup_lines, coalesce(five.n, 0) AS n_repeat_words, coalesce(ten.n, 0) AS covered_words,
      hundred.n > 0 AS too_long
    FROM d LEFT JOIN five USING (doc_id) LEFT JOIN ten USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN hundred USING (doc_id)),
  y AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x)
SELECT * EXCLUDE (too_long), NOT base_failed AND covered_words <= 0.3 * n_words AND too_long IS NULL AS kept FROM y"""


SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
  w AS ({_unnested("doc_id", "d", 50)}),
  gone AS (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS first FROM w) WHERE first < doc_id),
  lost AS (SELECT doc_id, list(DISTINCT q) AS qs FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RULES = ", ".join(f"({_quoted(r.verdict)}, {_quoted(r.host)}, {_quoted(r.path)})" for r in HOST_RULES)
_PATTERNS = " OR ".join(f"regexp_matches(host || path, {_quoted(p.regex)})" for p in PATTERNS)

URL_RULES = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
  rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
  fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
    FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {_PATTERNS} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fits USING (page_id)"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
  d AS (SELECT page_id, n, sha256(body) AS digest FROM p),
  f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)"""


def _round(i: int) -> str:
    """Assignment to the centroids c{i}, and the centroids after it."""
    return f"""
  a{i} AS (SELECT vec_id, x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT vec_id, x, cluster,
      list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY vec_id, x),
  m{i} AS (SELECT cluster, list(m ORDER BY i) AS m FROM (SELECT cluster, i, floor(sum(e) / count(*))::BIGINT AS m
      FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY cluster, i) GROUP BY cluster),
  c{i + 1} AS (SELECT cluster, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"""


CLUSTERS = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
  c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 16)),
  {",".join(_round(i) for i in range(4))},
  s AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a3) AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN s USING (cluster) JOIN c3 USING (cluster)"""
