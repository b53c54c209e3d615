"""DuckDB SQL with the results of the queries that SQL can express.

The others are tested against brute force in tests/llm: learned scores (op1, op6, op7), a
random rounding (op2), edit distances of lines (op4) and a tokenizer (op5) have no SQL.
"""

from .exact_dedup import OP8_SQL

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS (SELECT r, doc_id, n, hex(t) AS h FROM d),
win AS (SELECT r, k, md5(substr(h, 2 * k + 1, 400)) AS m FROM x, LATERAL (SELECT unnest(range(0, n - 199)) AS k)),
rep AS (SELECT r, k, lag(k) OVER (PARTITION BY r ORDER BY k) AS before FROM (SELECT r, k, count(*) OVER (PARTITION BY m) AS c FROM win) WHERE c > 1),
run AS (SELECT r, k, sum(CASE WHEN before IS NULL OR before + 200 < k THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM rep),
span AS (SELECT r, g, min(k) AS lo, max(k) + 200 AS hi FROM run GROUP BY r, g),
keep AS (SELECT r, g, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY g), 0) AS lo, lo AS hi FROM span),
tail AS (SELECT r, max(g) AS g, max(hi) AS hi, sum(hi - lo) AS gone, count(*) AS spans FROM span GROUP BY r),
left_over AS (SELECT keep.r, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY g) AS h FROM keep JOIN x ON x.r = keep.r GROUP BY keep.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(CASE WHEN tail.r IS NULL THEN unhex(x.h) ELSE unhex(coalesce(left_over.h, '') || substr(x.h, 2 * tail.hi + 1)) END) AS kept_sha256
FROM x LEFT JOIN tail ON tail.r = x.r LEFT JOIN left_over ON left_over.r = x.r
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(ws)) AS m FROM i WHERE len(ws) > 0),
pattern AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k + m - 1], ' '))) AS words FROM (SELECT item_id, ws, least(10, len(ws)) AS m FROM i WHERE len(ws) > 0)),
spot AS (SELECT doc_id, m, unnest(range(1, len(ws) - m + 2)) AS k, unnest(list_transform(range(1, len(ws) - m + 2), lambda k: array_to_string(ws[k:k + m - 1], ' '))) AS words FROM d, sizes WHERE len(ws) >= m),
found AS (SELECT doc_id, item_id, k, spot.m FROM spot JOIN pattern ON pattern.m = spot.m AND pattern.words = spot.words),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS w FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

SQL = {
    "op3_near_duplicates": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_run_index": OP9_SQL,
    "op10_decontamination": OP10_SQL,
}
