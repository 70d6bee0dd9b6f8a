"""Query of operator 7: rule ledger of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.llm import rules
from webloom.llm.registry import query, table

WS = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text,
        regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        length(regexp_replace(text, '{WS}', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
        length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) AS n_letters FROM t),
win AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
k AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS g FROM win),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM k) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, n_upper, n_letters
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, failed = 0 AS kept, failed, 'v1' AS policy_version
FROM (SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END)
  + (CASE WHEN 100 * n_upper > 50 * n_letters THEN 32 ELSE 0 END) + (CASE WHEN 100 * n_letters < 50 * word_chars THEN 64 ELSE 0 END) AS BIGINT) AS failed FROM m)
"""


@query("op7_rule_ledger", SQL)
def rule_ledger(spark, folder):
    policy = rules.Policy()
    book = rules.ledger(table(spark, folder, "documents").select("doc_id", "text"), policy)
    base = rules.Policy(version="base", enforced=rules.BASE)
    return book.select(
        "doc_id",
        *[F.col(f"m.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~rules.verdict(F.col("failed"), base)).alias("base_failed"),
        rules.verdict(F.col("failed"), policy).alias("kept"),
        "failed",
        F.lit(policy.version).alias("policy_version"),
    )
