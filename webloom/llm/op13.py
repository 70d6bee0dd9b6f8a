"""Query of operator 13: documents linked by four-word shingles at a Jaccard similarity of 0.85 or more."""

from __future__ import annotations

from webloom.llm.ngramjoin import ngram_join
from webloom.llm.op11 import LOWER, UPPER
from webloom.llm.registry import query, table

SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM met JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(b), n.doc_id)) AS component_id FROM n LEFT JOIN reach ON a = n.doc_id GROUP BY n.doc_id, n.n
"""


@query("op13_ngram_join", SQL)
def ngram_links(spark, folder):
    return ngram_join(table(spark, folder, "documents"), size=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")
