"""DuckDB SQL for the queries that SQL can express on whole tables."""

WORDS10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT k, array_to_string(ws[i : i + least(5, len(ws)) - 1], ' ') AS s FROM w, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS t(i) WHERE len(ws) > 0
), sizes AS (SELECT k, count(*) AS n FROM shingles GROUP BY k),
shared AS (SELECT a.k AS x, b.k AS y, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.k <> b.k GROUP BY a.k, b.k),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.k = x JOIN sizes b ON b.k = y WHERE 100 * met >= 80 * (a.n + b.n - met)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(doc_id) AS m FROM reach JOIN w ON w.k = y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (k) LEFT JOIN low ON low.x = w.k
"""

OP6 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT k, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM d, unnest(generate_series(0, n - 200)) AS t(i) WHERE n >= 200),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
marked AS (SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS gap FROM windows SEMI JOIN again USING (s)),
runs AS (SELECT k, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM marked),
spans AS (SELECT k, run, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY k, run),
cut AS (
  SELECT k, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept
  FROM (SELECT *, lag(z) OVER (PARTITION BY k ORDER BY a) AS before FROM spans) JOIN d USING (k) GROUP BY k
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (k)
"""

OP2 = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN best USING (k)
"""

OP4 = rf"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, {WORDS10} AS ws FROM documents),
items AS (SELECT item_id, {WORDS10} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM items, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS t(i) WHERE len(ws) > 0
),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (SELECT k, i, m, array_to_string(ws[i : i + m - 1], ' ') AS win FROM w, sizes, unnest(generate_series(1, len(ws) - m + 1)) AS t(i) WHERE len(ws) >= m),
found AS (SELECT k, i, m, item_id FROM grams JOIN windows USING (m, win)),
hits AS (SELECT k, count(DISTINCT p) AS n_hit FROM found, unnest(generate_series(i, i + m - 1)) AS t(p) GROUP BY k),
named AS (SELECT k, string_agg(s, ',' ORDER BY s) AS ids, count(*) AS n FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (k) LEFT JOIN named USING (k)
"""

OP5 = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         regexp_replace(text, '(<|\[)(\\*)(/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS body, regexp_replace(role, '(<|\[)(\\*)(/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS head FROM rows_
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(17 + length(head) + length(body)) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id
"""

OP10 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS low FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM g
"""

OP9 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), low AS (SELECT x, min(y) AS m FROM reach GROUP BY x), n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN low ON low.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

ORACLES = {
    "op1_ngram_jaccard_join": OP1,
    "op6_suffix_array_dedup": OP6,
    "op2_url_filters": OP2,
    "op4_benchmark_decontamination": OP4,
    "op5_chat_formatting": OP5,
    "op9_embedding_near_dedup": OP9,
    "op10_warc": OP10,
}
