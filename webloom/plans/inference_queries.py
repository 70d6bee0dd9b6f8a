"""Queries of whole-page inference (X10, X12, X13, A9, J6, T4, U3) on pages with ids, classes and attributes.

The pages are built from the links of the given ones: a head with an id, a list with a card for each link, and a
nest of plain elements that is deeper than a path is long. The SQL builds the same elements as rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import inference
from webloom.plans.registry import query
from webloom.plans.views import with_tables

NEST = 9

HEAD = '<!DOCTYPE html><html><head><title>t</title></head><body><div id="top" class="bar wide" data-page="p"><h1 itemprop="name">h</h1></div><ul id="menu" class="cards">'
TAIL = "</ul><div class=\"bar\">" + "<div>" * NEST + "<i>deep</i>" + "</div>" * NEST + "</div></body></html>"


def card_pages(t):
    """A page of cards for each page, one card for each of its links."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)

    def card(_, i):
        i, odd = i.cast("string"), (i % 2).cast("string")
        return F.concat(
            F.lit('<li class="card" data-no="'), i, F.lit('"><h2 class="name">n</h2><a id="go-'), i, F.lit('" class="more go" data-a="'), i,
            F.lit('" data-b="b" data-c="c" name="go" type="t'), odd, F.lit('">x</a></li>'),
        )

    return t.pages.select("page_id", F.concat(F.lit(HEAD), F.array_join(F.transform(links, card), ""), F.lit(TAIL)).alias("html"))


# Elements as rows: place, end and parent in document order, attributes, places among siblings.
_ELEMENTS = f"""
    SELECT page_id, pos, endp, par, tag, id, c, data, more, el, ty FROM (
        SELECT page_id, len(hrefs) AS m, 8 + 3 * len(hrefs) AS e FROM page_parts) p,
    LATERAL (
        SELECT * FROM (VALUES
            (1, e + {NEST} + 1, 0, 'html', '', []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], 1, 1),
            (2, 3, 1, 'head', '', [], [], [], 1, 1), (3, 3, 2, 'title', '', [], [], [], 1, 1),
            (4, e + {NEST} + 1, 1, 'body', '', [], [], [], 2, 1),
            (5, 6, 4, 'div', 'top', ['bar', 'wide'], ['[data-page=''p'']'], [], 1, 1),
            (6, 6, 5, 'h1', '', [], [], ['[itemprop=''name'']'], 1, 1), (7, e - 1, 4, 'ul', 'menu', ['cards'], [], [], 2, 1),
            (e, e + {NEST} + 1, 4, 'div', '', ['bar'], [], [], 3, 2),
            (e + {NEST} + 1, e + {NEST} + 1, e + {NEST}, 'i', '', [], [], [], 1, 1)) v(pos, endp, par, tag, id, c, data, more, el, ty)
        UNION ALL SELECT e + k, e + {NEST} + 1, e + k - 1, 'div', '', [], [], [], 1, 1 FROM range(1, {NEST} + 1) r(k)
        UNION ALL SELECT 8 + 3 * i, 10 + 3 * i, 7, 'li', '', ['card'], ['[data-no=''' || i || ''']'], [], i + 1, i + 1 FROM range(0, m) r(i)
        UNION ALL SELECT 9 + 3 * i, 9 + 3 * i, 8 + 3 * i, 'h2', '', ['name'], [], [], 1, 1 FROM range(0, m) r(i)
        UNION ALL SELECT 10 + 3 * i, 10 + 3 * i, 8 + 3 * i, 'a', 'go-' || i, ['more', 'go'], ['[data-a=''' || i || ''']', '[data-b=''b'']', '[data-c=''c'']'],
            ['[name=''go'']', '[type=''t' || i % 2 || ''']'], 2, 1 FROM range(0, m) r(i))"""
_NODE = """
    SELECT *, coalesce(c[1], '') AS cls, list_concat(CASE WHEN id <> '' THEN ['#' || id] ELSE [] END, list_transform(c, lambda x: tag || '.' || x),
        [tag || ':nth-child(' || el || ')', tag || '[' || ty || ']']) AS steps FROM element"""
# Paths: upwards to the nearest id, to the body or over eight elements.
_CLIMB = """
    SELECT page_id, pos AS x, pos AS cur, par, id, 1 AS size, [CASE WHEN id <> '' THEN '#' || id WHEN cls <> '' THEN tag || '.' || cls
        ELSE tag || ':nth-child(' || el || ')' END] AS css, [CASE WHEN id <> '' THEN '#' || id ELSE tag || '[' || ty || ']' END] AS xp FROM node WHERE tag <> 'html'
    UNION ALL SELECT k.page_id, x, n.pos, n.par, n.id, size + 1,
        list_concat([CASE WHEN n.id <> '' THEN '#' || n.id WHEN n.cls <> '' THEN n.tag || '.' || n.cls ELSE n.tag || ':nth-child(' || n.el || ')' END], css),
        list_concat([CASE WHEN n.id <> '' THEN '#' || n.id ELSE n.tag || '[' || n.ty || ']' END], xp)
    FROM climb k JOIN node n ON n.page_id = k.page_id AND n.pos = k.par WHERE k.id = '' AND n.tag <> 'html' AND size < 8"""
_PATH = """
    SELECT page_id, x, unnest([{'kind': 'css', 'path': css}, {'kind': 'xpath', 'path': xp}], recursive := true)
    FROM (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY page_id, x ORDER BY size DESC) = 1)"""
_WALK = """
    SELECT p.page_id, path, 1 AS j, pos FROM (SELECT DISTINCT page_id, path FROM path) p JOIN node n ON n.page_id = p.page_id AND list_contains(n.steps, path[1])
    UNION ALL SELECT w.page_id, path, j + 1, n.pos FROM walk w JOIN node n ON n.page_id = w.page_id AND n.par = w.pos AND list_contains(n.steps, path[j + 1])
    WHERE j < len(path)"""
_CANDIDATE = """
    SELECT page_id, pos, 0 AS i, 'css' AS kind, '#' || id AS expr, (SELECT count(*) FROM node m WHERE m.page_id = n.page_id AND m.id = n.id) AS hits FROM node n WHERE id <> ''
    UNION ALL SELECT page_id, pos, 1, 'xpath', '//*[@id=''' || id || ''']', (SELECT count(*) FROM node m WHERE m.page_id = n.page_id AND m.id = n.id) FROM node n WHERE id <> ''
    UNION ALL SELECT d.page_id, d.pos, 2 * k + p.o, p.kind, CASE WHEN p.o = 0 THEN v ELSE '//*[@' || v[2:] END, (SELECT count(*) FROM node m WHERE m.page_id = d.page_id AND list_contains(m.data, v))
        FROM (SELECT page_id, pos, unnest(data) AS v, unnest(range(1, len(data) + 1)) AS k FROM node) d, (VALUES (0, 'css'), (1, 'xpath')) p(o, kind)
    UNION ALL SELECT page_id, pos, 20 + k, 'css', tag || '.' || v, (SELECT count(*) FROM node m WHERE m.page_id = d.page_id AND m.tag = d.tag AND list_contains(m.c, v))
        FROM (SELECT page_id, pos, tag, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS k FROM node) d
    UNION ALL SELECT n.page_id, n.pos, 30, 'css', '#' || u.id || CASE WHEN n.cls <> '' THEN ' .' || n.cls ELSE ' ' || n.tag END,
        (SELECT count(*) FROM node m JOIN node a ON a.page_id = m.page_id AND m.pos > a.pos AND m.pos <= a.endp
            WHERE m.page_id = n.page_id AND a.id = u.id AND CASE WHEN n.cls <> '' THEN list_contains(m.c, n.cls) ELSE m.tag = n.tag END)
        FROM node n JOIN node u ON u.page_id = n.page_id AND u.pos = n.par AND u.id <> ''
    UNION ALL SELECT n.page_id, n.pos, 31, 'xpath', '//*[@id=''' || u.id || ''']//' || n.tag,
        (SELECT count(*) FROM node m JOIN node a ON a.page_id = m.page_id AND m.pos > a.pos AND m.pos <= a.endp WHERE m.page_id = n.page_id AND a.id = u.id AND m.tag = n.tag)
        FROM node n JOIN node u ON u.page_id = n.page_id AND u.pos = n.par AND u.id <> ''
    UNION ALL SELECT page_id, pos, 40, 'css', tag || CASE WHEN cls <> '' THEN '.' || cls ELSE '' END || array_to_string(more, ''),
        (SELECT count(*) FROM node m WHERE m.page_id = n.page_id AND m.tag = n.tag AND (n.cls = '' OR list_contains(m.c, n.cls)) AND list_has_all(m.more, n.more)) FROM node n WHERE len(more) > 0
    UNION ALL SELECT p.page_id, x, CASE kind WHEN 'css' THEN 50 ELSE 51 END, kind, CASE kind WHEN 'css' THEN array_to_string(p.path, ' > ')
        ELSE '//' || array_to_string(list_transform(p.path, lambda s: CASE WHEN starts_with(s, '#') THEN '*[@id=''' || s[2:] || ''']' ELSE s END), '/') END, coalesce(w.hits, 0)
        FROM path p LEFT JOIN (SELECT page_id, path, count(*) AS hits FROM walk WHERE j = len(path) GROUP BY 1, 2) w ON w.page_id = p.page_id AND w.path = p.path
    UNION ALL SELECT page_id, pos, CASE kind WHEN 'css' THEN 50 ELSE 51 END, kind, expr, 0 FROM node, (VALUES ('css', ''), ('xpath', '//')) v(kind, expr) WHERE tag = 'html'"""
_SCORED = """
    SELECT *, greatest(0.05, least(1.0, CASE WHEN starts_with(expr, '#') OR contains(expr, '[@id=') THEN 0.98 WHEN contains(expr, 'data-') THEN 0.93
            WHEN contains(expr, '.') AND NOT contains(expr, 'nth-child') THEN 0.82 WHEN contains(expr, '[') THEN 0.7 ELSE 0.45 END
        + CASE WHEN hits = 1 THEN 0.05 WHEN hits > 1 THEN -0.15 ELSE 0 END + CASE kind WHEN 'xpath' THEN -0.04 ELSE 0 END))::DOUBLE AS score
    FROM (SELECT * FROM candidate QUALIFY row_number() OVER (PARTITION BY page_id, pos, kind, expr ORDER BY i) = 1)"""


def _tables(*names: str) -> str:
    known = {"element": _ELEMENTS, "node": _NODE, "climb": _CLIMB, "path": _PATH, "walk": _WALK, "candidate": _CANDIDATE, "scored": _SCORED}
    return with_tables("page_parts", recursive=True, **{n: known[n] for n in names})


@query(
    "x12_all_candidates",
    _tables("element", "node", "climb", "path", "walk", "candidate", "scored")
    + """SELECT page_id, pos AS node_id, rank, kind, expr, hits = 1 AS "unique", round(score, 6) AS score, hits
         FROM (SELECT *, row_number() OVER (PARTITION BY page_id, pos ORDER BY round(score, 9) DESC, strlen(expr), i) AS rank FROM scored) WHERE rank <= 8""",
    rank="INTEGER", hits="INTEGER", node_id="INTEGER",
)
def all_candidates(t):
    """The best eight selectors of every element of every page."""
    found = inference.page_candidates(inference.page_elements(card_pages(t)))
    return found.withColumn("score", F.round("score", 6))


@query(
    "x13_all_list_rules",
    _tables("element", "node")
    + """, shape AS (SELECT n.page_id, n.pos, n.par, n.tag || '|' || n.cls || '|' || coalesce(string_agg(k.tag || '.' || k.cls, ',' ORDER BY k.pos), '') AS sig
            FROM node n LEFT JOIN node k ON k.page_id = n.page_id AND k.par = n.pos GROUP BY n.page_id, n.pos, n.par, n.tag, n.cls),
         twin AS (SELECT page_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY page_id, par, sig) AS n FROM shape) WHERE n >= 3 AND par > 0),
         up AS (SELECT page_id, pos AS x, pos AS cur, par, 0 AS i, NULL::VARCHAR AS near FROM node WHERE tag NOT IN ('html', 'body')
            UNION ALL SELECT u.page_id, x, n.pos, n.par, i + 1, coalesce(near, nullif(b.cls, '')) FROM up u JOIN node b ON b.page_id = u.page_id AND b.pos = u.cur
            JOIN node n ON n.page_id = u.page_id AND n.pos = u.par WHERE n.tag NOT IN ('html', 'body')),
         rule AS (SELECT u.page_id, x, i, CASE WHEN a.cls <> '' THEN '.' || a.cls WHEN a.id <> '' THEN '#' || a.id ELSE a.tag END AS item,
            coalesce('.' || CASE WHEN i = 0 THEN nullif(a.cls, '') ELSE near END, s.tag) AS field
            FROM up u JOIN twin USING (page_id) JOIN node a ON a.page_id = u.page_id AND a.pos = u.cur JOIN node s ON s.page_id = u.page_id AND s.pos = x WHERE twin.pos = u.cur),
         held AS (SELECT r.page_id, item, field, count(DISTINCT a.pos) AS hits FROM (SELECT DISTINCT page_id, item, field FROM rule) r
            JOIN node a ON a.page_id = r.page_id AND (item = a.tag OR item = '#' || a.id OR list_contains(a.c, item[2:]) AND starts_with(item, '.'))
            JOIN node f ON f.page_id = r.page_id AND f.pos > a.pos AND f.pos <= a.endp AND (field = f.tag OR list_contains(f.c, field[2:]) AND starts_with(field, '.')) GROUP BY ALL),
         best AS (SELECT * FROM rule JOIN held USING (page_id, item, field) QUALIFY row_number() OVER (PARTITION BY page_id, x ORDER BY hits DESC, i) = 1)
       SELECT n.page_id, n.pos AS node_id, coalesce(item, '') AS item_selector, coalesce(field, CASE WHEN n.cls <> '' THEN '.' || n.cls ELSE n.tag END) AS field_selector, coalesce(hits, 1) AS hits
       FROM node n LEFT JOIN best b ON b.page_id = n.page_id AND b.x = n.pos""",
    node_id="INTEGER",
)
def all_list_rules(t):
    """The list rule of a click on every element of every page."""
    return inference.page_list_rules(inference.page_elements(card_pages(t)))
