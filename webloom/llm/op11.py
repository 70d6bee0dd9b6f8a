"""Query of operator 11: a quarter of the documents drawn by their likeness to the benchmark."""

from __future__ import annotations

from webloom.llm.op12 import CRC32
from webloom.llm.registry import query, table
from webloom.llm.resample import BUCKETS, resample

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _features(source: str, key: str) -> str:
    """(key, n_words, f): words and word pairs of each row's text."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""SELECT id, len(words) AS n_words, list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS f
        FROM (SELECT {key} AS id, {words} AS words FROM {source})"""


SQL = f"""
WITH docs AS ({_features("documents", "doc_id")}), goal AS ({_features("benchmark", "item_id")}),
s0 AS (SELECT f, count(*) AS n FROM (SELECT unnest(f) AS f FROM docs) GROUP BY f),
t0 AS (SELECT f, count(*) AS n FROM (SELECT unnest(f) AS f FROM goal) GROUP BY f),
words AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM s0 UNION SELECT f FROM t0)),
hashed AS MATERIALIZED (SELECT f, {CRC32.replace("range(1, length({0}) + 1)", "range(1, length(x) + 1, 2)").replace("ord(({0})[i])::BIGINT", "('0x' || x[i:i + 1])::BIGINT")} % {BUCKETS} AS b FROM words),
s AS (SELECT b, sum(n) AS n FROM s0 JOIN hashed USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS n FROM t0 JOIN hashed USING (f) GROUP BY b),
size AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + {BUCKETS} AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + {BUCKETS} AS t),
gain AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * size.s / ((s.n + 1)::DOUBLE * size.t)))::BIGINT AS g FROM s LEFT JOIN t USING (b), size),
used AS (SELECT id, unnest(f) AS f FROM docs),
summed AS (SELECT id, sum(g)::BIGINT AS g FROM used JOIN hashed USING (f) JOIN gain USING (b) GROUP BY id),
w AS (SELECT id AS doc_id, n_words, len(f) AS n_features, CASE WHEN len(f) = 0 THEN 0 ELSE (g - ((g % len(f)) + len(f)) % len(f)) // len(f) END AS weight FROM docs LEFT JOIN summed USING (id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN able USING (doc_id)
"""


@query("op11_target_sample", SQL)
def target_sample(spark, folder):
    return resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
