"""DuckDB SQL of the queries that SQL can express."""

OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS span
                 FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
                       FROM (SELECT *, least(len(w), 10) AS m FROM b WHERE len(w) > 0))),
doc_windows AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS span
                FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s
                      FROM d CROSS JOIN (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)),
found AS (SELECT doc_id, m, s, item_id FROM doc_windows JOIN item_windows USING (m, span)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
