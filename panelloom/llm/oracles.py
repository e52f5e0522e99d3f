"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, s, sha256(array_to_string(ws[s:s + 49], ' ')) AS k FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS s) t),
earliest AS (SELECT k, min(doc_id) AS d FROM windows GROUP BY 1),
hits AS (SELECT doc_id, s, 1 AS hit FROM windows JOIN earliest USING (k) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS s FROM w),
marked AS (SELECT doc_id, word, s, count(hit) OVER (PARTITION BY doc_id ORDER BY s ROWS 49 PRECEDING) > 0 AS gone FROM words LEFT JOIN hits USING (doc_id, s)),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY s) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

OP6 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, unnest(list_transform(range(1, length(h) // 2 + 1), lambda s: substr(h, 2 * s - 1, 100))) AS k, unnest(range(1, length(h) // 2 + 1)) AS s FROM h),
bytes AS (SELECT doc_id, s, substr(k, 1, 2) AS b, CASE WHEN length(k) = 100 THEN md5(k) END AS k FROM pieces),
earliest AS (SELECT k, min(doc_id) AS d FROM bytes WHERE k IS NOT NULL GROUP BY 1),
marked AS (SELECT doc_id, s, b, count(*) FILTER (WHERE d < doc_id) OVER (PARTITION BY doc_id ORDER BY s ROWS 49 PRECEDING) > 0 AS gone FROM bytes LEFT JOIN earliest USING (k)),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), false) AS opens FROM marked),
kept AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY s) FILTER (WHERE NOT gone), '') AS kept FROM runs GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
