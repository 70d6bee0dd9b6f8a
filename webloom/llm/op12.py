"""Query of operator 12: prefix trie of conversations rebuilt around shared first turns."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from webloom.llm import trie
from webloom.llm.registry import query, table

EVERY = 20
SHARED = 4

#: crc32 of a text of ASCII characters, bit by bit: a code point is mixed in, then eight shifts (each marked by -1).
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({0}) + 1),
    lambda i: list_concat([ord(({0})[i])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY turn NULLS FIRST, role, text) AS s,
    list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY turn NULLS FIRST, role, text) AS w FROM t GROUP BY conv_id),
k AS (SELECT *, CAST({CRC32.format("conv_id::VARCHAR")} % {SHARED} AS BIGINT) AS h FROM own),
r AS (SELECT k.conv_id, list_concat(coalesce(p.s[1:k.h], []), k.s[k.h + 1:]) AS s, list_concat(coalesce(p.w[1:k.h], []), k.w[k.h + 1:]) AS w
    FROM k LEFT JOIN own p ON p.conv_id = k.conv_id - k.conv_id % {EVERY}),
pre AS (SELECT conv_id, d AS depth, s[1:d] AS p, s[1:d - 1] AS up, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, len(s) = d AS ends
    FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)),
node AS (SELECT p, depth, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM pre GROUP BY p, depth),
kid AS (SELECT up AS p, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (p, depth)),
above AS (SELECT *, unnest(range(0, depth + 1)) AS a FROM full_node),
below AS (SELECT p[1:a] AS p, a AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM full_node n JOIN below b ON b.p = n.p AND b.depth = n.depth LEFT JOIN node up ON n.depth > 0 AND up.p = n.up AND up.depth = n.depth - 1
"""


def rebuilt(seqs):
    """Each conversation after the first turns of the one that leads its group of ``EVERY``, none if that is absent."""
    own, none = F.col("turns"), F.array().cast(trie.NO_TURNS)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    lead = (F.col("conv_id") - F.col("conv_id") % EVERY).alias("lead")
    heads = seqs.filter(F.col("conv_id") % EVERY == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, SHARED - 1).alias("head"))
    both = seqs.select("conv_id", "turns", lead, h.alias("h")).join(heads, "lead", "left")
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


@query("op12_prefix_trie", SQL)
def prefix_trie(spark, folder):
    found = trie.build(rebuilt(trie.sequences(table(spark, folder, "conversations"))))
    nothing = hashlib.sha256(b"").hexdigest()
    nodes = found.nodes.join(trie.digest_of_ends(found.ends), "node", "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")
    )
