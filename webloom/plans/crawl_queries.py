"""Queries over page corpora: shredding, extraction, links, robots, frontier, induction (X, J4-J7, J11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.selectors import css_plan_lit, path_plan_lit
from webloom.functions.urls import canonical_url, host_of
from webloom.operators import boxes, dedup, extract, frontier, induction, robots
from webloom.operators.crawlstep import crawl_step
from webloom.plans.registry import query
from webloom.plans.views import with_tables

FIELDS = "array<struct<name:string,kind:string,expr:string,attr:string>>"


def _links(t):
    return extract.links_of(extract.with_dom(t.pages.select("page_id", "url", "html")), "nav a")


@query(
    "fresh_links_per_host",
    with_tables("page_links")
    + """SELECT host, count(*) AS links FROM (SELECT DISTINCT host, link FROM page_links
         WHERE link NOT IN (SELECT canonical FROM page_parts)) GROUP BY host""",
)
def fresh_links_per_host(t):
    """Flagship: page → elements → links → canonical URLs → distinct, not crawled yet → per host."""
    known = t.pages.select(F.lit(0).alias("task_id"), canonical_url(F.col("url")).alias("url"))
    offers = _links(t).select(F.lit(0).alias("task_id"), F.col("link").alias("url"))
    fresh = dedup.fresh_urls(offers, known)
    return fresh.groupBy(host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("links"))


# Shredding ------------------------------------------------------------------------------------

# Tags whose count does not depend on how unclosed formatting elements are repaired.
_TAGS = ["a", "li", "p", "h1", "ul", "nav", "div", "article", "footer", "br", "title", "meta", "html", "head", "body"]


@query(
    "x1_shred_counts",
    f"""SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS n
        FROM pages, (SELECT unnest({_TAGS}) AS tag) WHERE n > 0""",
)
def shred_counts(t):
    nodes = extract.dom_nodes(extract.with_dom(t.pages), with_text=False)
    return nodes.filter(F.col("tag").isin(*_TAGS)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("x1_dom_nodes")
def dom_nodes(t):
    """The node table itself (its ids depend on repaired markup, so there is no SQL twin)."""
    return extract.dom_nodes(extract.with_dom(t.pages)).select(
        "page_id", "node_id", "end_id", "parent_id", "tag", "own_text", "text", "sib_idx", "depth"
    )


@query(
    "w8_sibling_positions",
    with_tables("page_parts") + "SELECT page_id, len(hrefs) - 1 AS last_sibling, len(hrefs) AS last_of_type FROM page_parts",
    last_sibling="INTEGER", last_of_type="INTEGER",
)
def sibling_positions(t):
    places = induction.sibling_positions(extract.dom_nodes(extract.with_dom(t.pages), with_text=False)).filter("tag = 'li'")
    return places.groupBy("page_id").agg(
        F.max("sib_idx").alias("last_sibling"), F.max("type_idx").alias("last_of_type")
    )


@query("p12_visible_nodes")
def visible_nodes(t):
    return boxes.visible_nodes(extract.dom_nodes(extract.with_dom(t.pages))).select("page_id", "node_id", "tag", "text")


# Extraction -----------------------------------------------------------------------------------


@query(
    "j5_elements_in_items",
    with_tables("page_parts")
    + """SELECT page_id, 'article' AS item, len(regexp_extract_all(article, '<p>')) AS inside FROM page_parts
         UNION ALL SELECT page_id, 'nav', len(regexp_extract_all(html, '<li>')) FROM page_parts""",
    inside="INTEGER",
)
def elements_in_items(t):
    """Matches of a selector below each item: the scope of an item is a slice of its page."""
    doms = extract.with_dom(t.pages)
    none = F.lit(None).cast("int")

    def inside(item: str, field: str):
        found = extract.select_nodes(F.col("dom.nodes"), css_plan_lit(item), F.lit(0), none)
        n = F.col("n")
        scoped = F.slice(F.col("dom.nodes"), n["pos"], n["end_pos"] - n["pos"] + 1)
        hits = F.size(extract.select_nodes(scoped, css_plan_lit(field), n["pos"] - 1, none))
        rows = doms.select("page_id", "dom", F.explode(found).alias("n"))
        return rows.select("page_id", F.lit(item).alias("item"), hits.alias("inside"))

    return inside("article", "p").union(inside("nav", "li"))


@query(
    "j6_list_hits",
    with_tables("page_parts") + "SELECT page_id, len(hrefs) AS hits FROM page_parts",
    hits="INTEGER",
)
def list_hits(t):
    return induction.list_hits(extract.with_dom(t.pages), css_plan_lit("nav li"), css_plan_lit("a[href]"))


_ARTICLE_TEXT = r"""replace(replace(regexp_replace(regexp_replace(article, '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'),
    '&quot;', '"'), '&lt;', '<')"""


@query(
    "x2_x8_page_records",
    with_tables("page_parts", "page_links")
    + rf"""SELECT page_id, 1 AS items, trim(h1) AS title, trim(h1) AS title_x, '/body/article' AS at,
                  trim(regexp_extract(trim({_ARTICLE_TEXT}), '(\w+)\.', 1)) AS word,
                  (SELECT count(*) FROM page_links l WHERE l.page_id = p.page_id) AS links
           FROM page_parts p""",
    links="INTEGER",
)
def page_records(t):
    """One rule over all pages: CSS, XPath and regex fields of the article, links of the navigation."""
    fields = [
        {"name": "title", "kind": "css", "expr": "h1", "attr": "text"},
        {"name": "title_x", "kind": "xpath", "expr": ".//h1[1]", "attr": ""},
        {"name": "word", "kind": "regex", "expr": r"(\w+)\.", "attr": "text"},
        {"name": "broken", "kind": "json", "expr": "x", "attr": ""},
    ]
    out = extract.preview(t.pages, "article", "nav a", fields)
    item = F.get("items", F.lit(0))
    return out.select(
        "page_id",
        F.size("items").alias("items"),
        *[F.element_at(item, k).alias(k) for k in ("title", "title_x", "word")],
        F.lit("/body/article").alias("at"),
        F.size("links").alias("links"),
    )


def _form(name: str, oracle: str, selector: str = "", path: str = "") -> None:
    """Register the number of elements of every page that one selector matches."""

    def hits(t):
        doms = extract.with_dom(t.pages)
        if selector:
            return induction.count_css(doms, css_plan_lit(selector))
        found = extract.select_nodes(F.col("dom.nodes"), path_plan_lit(path), F.lit(0), F.lit(0), F.col("dom.text"))
        return doms.select("page_id", F.size(found).alias("hits"))

    hits.__doc__ = f"Elements that match {selector or path}."
    query(name, with_tables("page_parts") + f"SELECT page_id, {oracle} AS hits FROM page_parts", hits="INTEGER")(hits)


_NAV_TEXTS = """regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)"""
_form("x3_has", "len([h FOR h IN hrefs IF starts_with(h, '/t')])", "li:has(> a[href^='/t'])")
_form(
    "x3_not_compound",
    "len([h FOR h IN hrefs IF NOT (starts_with(h, '/t') AND ends_with(h, 'e'))])",
    "nav a:not([href^='/t'][href$='e'])",
)
_form("x3_contains", f"len([x FOR x IN {_NAV_TEXTS} IF contains(x, 'the')])", "nav li:contains('the')")
_form("x4_union", "1 + len([h FOR h IN hrefs IF NOT contains(h, 'e')])", path="//nav//a[not(contains(@href, 'e'))] | //h1")
_form("x4_text_tests", f"len([x FOR x IN {_NAV_TEXTS} IF starts_with(x, 't')])", path="//li/a[starts-with(text(), 't')]")
_T_PLACES = "[i FOR i IN range(1, len(hrefs) + 1) IF starts_with(hrefs[i], '/t')]"
_form("x4_siblings_after", f"coalesce(len(hrefs) - list_min({_T_PLACES}), 0)", path="//li[a[starts-with(@href, '/t')]]/following-sibling::li")
_form("x4_siblings_before", f"coalesce(list_max({_T_PLACES}) - 1, 0)", path="//li[a[starts-with(@href, '/t')]]/preceding-sibling::li")
_form("x4_parents", f"CASE WHEN len({_T_PLACES}) > 0 THEN len({_T_PLACES}) + 1 ELSE 0 END",
      path="//a[starts-with(@href, '/t')]/.. | //a[starts-with(@href, '/t')]/ancestor::ul[1]")
_form("x4_positions", "greatest(0, len(hrefs) - 3)", path="//li[position() > 2 and position() < last()]")
_form("x4_counts", "CASE WHEN len(hrefs) >= 5 THEN 1 ELSE 0 END", path="//ul[count(li) >= 5]")
_form("x4_either", "len([h FOR h IN hrefs IF starts_with(h, '/t') OR contains(h, 'e')])", path="//nav//a[starts-with(@href, '/t') or contains(@href, 'e')]")
_form("x4_filtered_position", f"least(1, greatest(0, len([x FOR x IN {_NAV_TEXTS} IF contains(x, 'the')]) - 1))", path="//li[contains(., 'the')][2]")
_form("x4_nth_of_all", "greatest(0, len(hrefs) - 2)", path="(//li)[2]/following-sibling::li")


@query(
    "t6_first_match",
    with_tables("page_parts")
    + "SELECT page_id, replace(regexp_replace(hrefs[1], '&amp;', '&', 'g'), '&quot;', '\"') AS first_href FROM page_parts",
)
def first_match(t):
    fields = [{"name": "first", "kind": "css", "expr": "li > a", "attr": "href"}]
    out = extract.preview(t.pages, "", "", fields)
    return out.select("page_id", F.element_at(F.get("items", F.lit(0)), "first").alias("first_href"))


@query(
    "x6_attribute_values",
    with_tables("page_parts")
    + """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, 'ad' AS ad_class, '' AS missing,
                trim(replace(replace(replace(replace(replace(h1, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'),
                     chr(39), '&#39;')) AS h1_html FROM page_parts""",
)
def attribute_values(t):
    """Named attributes, inner HTML and misses."""
    fields = [
        {"name": "lang", "kind": "css", "expr": "html", "attr": "lang"},
        {"name": "ad_class", "kind": "xpath", "expr": "//div[@class='ad']/@class", "attr": ""},
        {"name": "missing", "kind": "css", "expr": "nav a", "attr": "title"},
        {"name": "h1_html", "kind": "css", "expr": "article h1", "attr": "html"},
    ]
    out = extract.preview(t.pages, "", "", fields)
    item = F.get("items", F.lit(0))
    return out.select("page_id", *[F.element_at(item, f["name"]).alias(f["name"]) for f in fields])


@query(
    "u2_links_of_pages",
    with_tables("page_links") + "SELECT page_id, link FROM page_links",
)
def links_of_pages(t):
    return _links(t).select("page_id", "link")


@query(
    "s5_result_rows",
    with_tables("page_parts")
    + """SELECT page_id % 50 AS task_id, url, trim(h1) AS title, url AS stamped, 2 AS n_keys FROM page_parts""",
)
def result_rows(t):
    out = extract.preview(t.pages, "article", "", [{"name": "title", "kind": "css", "expr": "h1"}])
    rows = extract.result_rows(out, F.col("page_id") % 50)
    return rows.select(
        "task_id",
        "url",
        F.element_at("payload", "title").alias("title"),
        F.element_at("payload", "_url").alias("stamped"),
        F.size("payload").alias("n_keys"),
    )


def _field(name: str, kind: str, expr: str, attr: str = ""):
    return F.struct(*[F.lit(v).alias(k) for k, v in
                      {"name": name, "kind": kind, "expr": expr, "attr": attr}.items()])


def _host_rules(t):
    """A rule per host, of one of three kinds by the length of the host name."""
    hosts = t.pages.select(host_of(F.col("url")).alias("host")).distinct()
    kind = F.length("host") % 3
    return hosts.select(
        "host",
        F.length("host").cast("bigint").alias("id"),
        F.when(kind == 0, "article").when(kind == 1, "nav li").otherwise("").alias("item_selector"),
        F.when(kind == 2, "").otherwise("nav a").alias("link_selector"),
        F.when(kind == 0, F.array(_field("v", "css", "h1")))
        .when(kind == 1, F.array(_field("v", "xpath", ".//a/@href")))
        .otherwise(F.array(_field("v", "css", "article h1"), _field("x", "regex", "(", "text")))
        .alias("fields"),
        (F.length("host") % 2 == 0).alias("respect_robots"),
    )


@query(
    "x9_many_rules",
    with_tables("page_parts", "page_links")
    + """SELECT page_id, CASE length(host) % 3 WHEN 1 THEN len(hrefs) ELSE 1 END AS items,
                CASE length(host) % 3 WHEN 1 THEN replace(replace(hrefs[1], '&amp;', '&'), '&quot;', '"') ELSE trim(h1) END AS first_value,
                length(host) % 3 = 2 AS has_error,
                CASE WHEN length(host) % 3 = 2 THEN 0 ELSE (SELECT count(*) FROM page_links l WHERE l.page_id = p.page_id) END AS links
         FROM page_parts p""",
    items="INTEGER", links="INTEGER",
)
def many_rules(t):
    pages = t.pages.withColumn("host", host_of(F.col("url")))
    out = extract.extract_by_rules(pages, _host_rules(t), ["host"])
    item = F.get("items", F.lit(0))
    return out.select(
        "page_id",
        F.size("items").alias("items"),
        F.element_at(item, "v").alias("first_value"),
        F.map_contains_key(item, "x_error").alias("has_error"),
        F.size("links").alias("links"),
    )


# Robots ---------------------------------------------------------------------------------------


@query("x14_robots_policies", with_tables("robots_rows") + "SELECT host, kind, prefix, delay FROM robots_rows")
def robots_policies(t):
    return robots.policy_rows(t.robots)


@query(
    "j4_robots_check",
    with_tables("url_allowed", d="SELECT DISTINCT host, delay FROM robots_rows")
    + "SELECT page_id, no = 0 OR yes > no AS allowed, delay FROM url_allowed u JOIN d ON u.host = d.host",
)
def robots_check(t):
    return robots.check_robots(t.pages.select("page_id", "url"), t.robots).select("page_id", "allowed", "delay")


# Boxes, link graph, frontier ----------------------------------------------------------------------


@query(
    "j7_hit_test",
    """WITH p AS (SELECT event_id AS point_id, event_id % 20 AS page_id, value * 3 AS x, user_id * 4.0 AS y FROM events),
            b AS (SELECT p_partkey AS node_id, p_partkey % 20 AS page_id, (p_partkey * 37 % 900)::DOUBLE AS x,
                         (p_partkey * 53 % 500)::DOUBLE AS y, p_size * 9.0 - 9 AS w, p_size * 5.0 AS h FROM part)
       SELECT page_id, point_id, node_id, area FROM (
         SELECT p.page_id, point_id, node_id, w * h AS area,
                row_number() OVER (PARTITION BY p.page_id, point_id ORDER BY w * h, node_id) AS rn
         FROM p JOIN b ON p.page_id = b.page_id AND p.x BETWEEN b.x AND b.x + b.w AND p.y BETWEEN b.y AND b.y + b.h
         WHERE w * h > 0) WHERE rn = 1""",
    area="DOUBLE",
)
def hit_test(t):
    points = t.events.select(
        (F.col("event_id") % 20).alias("page_id"), F.col("event_id").alias("point_id"),
        (F.col("value") * 3).alias("x"), (F.col("user_id") * 4.0).alias("y"),
    )
    k, size = F.col("p_partkey"), F.col("p_size")
    drawn = t.part.select(
        (k % 20).alias("page_id"), k.alias("node_id"), (k * 37 % 900).cast("double").alias("x"),
        (k * 53 % 500).cast("double").alias("y"), (size * 9.0 - 9).alias("w"), (size * 5.0).alias("h"),
    )
    return boxes.hit_test(points, drawn)


@query(
    "j11_link_graph",
    with_tables("page_parts")
    + """SELECT p.page_id AS from_page, coalesce(q.canonical, 'http://nowhere.example/') AS link,
                (SELECT min(page_id) FROM page_parts k WHERE k.canonical = q.canonical) AS to_page
         FROM page_parts p LEFT JOIN page_parts q ON q.page_id = p.page_id + 1""",
)
def link_graph(t):
    """Every page links to the next one, under another spelling of its URL."""
    target = t.pages.select((F.col("page_id") - 1).alias("page_id"), F.concat("url", F.lit("#x")).alias("_next"))
    rows = t.pages.select("page_id").join(target, "page_id", "left")
    link = canonical_url(F.coalesce(F.regexp_replace("_next", "^http", "HTTP"), F.lit("http://nowhere.example")))
    return frontier.link_graph(rows.select("page_id", link.alias("link")), t.pages)


@query(
    "x15_frontier",
    with_tables(
        "edges",
        reach="""SELECT o_custkey AS task_id, 'o' || CAST(o_orderkey AS VARCHAR) AS url, 0 AS depth FROM orders
                 UNION SELECT r.task_id, e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.url""",
        recursive=True,
    )
    + "SELECT task_id, url, min(depth) AS depth FROM reach GROUP BY task_id, url",
)
def frontier_rounds(t):
    """Every customer is a task and starts from all its orders; rounds go on until nothing new is found."""
    seeds = t.orders.select(F.col("o_custkey").alias("task_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("url"))
    return frontier.expand_frontier(seeds, t.edges)


# One crawl step -----------------------------------------------------------------------------------


def _step(t):
    k = F.col("page_id")
    pages = t.pages
    jobs = pages.select(
        "page_id", (k % 50).alias("task_id"), F.length(host_of(F.col("url"))).cast("bigint").alias("rule_id"),
        "url", (k % 3).cast("int").alias("depth"),
    )
    tasks = t.tasks.select(
        F.col("id").alias("task_id"),
        F.when(F.col("status").isin("running", "paused"), "running").otherwise(F.col("status")).alias("status"),
        F.lit(2).alias("max_depth"),
    )
    rules = _host_rules(t).dropDuplicates(["id"]).withColumnRenamed("id", "rule_id").drop("host")
    fetched = pages.select(
        "page_id", "url", "html",
        F.when(k % 7 == 0, 503).when(k % 11 != 0, 200).alias("status"),
    )
    return crawl_step(jobs, tasks, rules, fetched, t.robots, with_html=False, fetch=("page_id", "url")), jobs


_STEP = with_tables(
    "page_parts", "page_links", "tasks", "url_allowed",
    j="""SELECT p.page_id, p.page_id % 50 AS task_id, canonical AS url, p.page_id % 3 AS depth, length(p.host) AS hl,
                CASE WHEN p.page_id % 7 = 0 THEN 503 WHEN p.page_id % 11 <> 0 THEN 200 END AS status,
                length(p.host) % 2 = 0 AND NOT (no = 0 OR yes > no) AS skip, len(hrefs) AS n_links
         FROM page_parts p JOIN url_allowed u ON u.page_id = p.page_id""",
    f="""SELECT j.* FROM j JOIN tasks t ON t.id = j.task_id WHERE t.status IN ('running', 'paused')""",
    ok="SELECT * FROM f WHERE NOT skip AND status = 200",
    o="""SELECT ok.task_id, l.link FROM ok JOIN page_links l ON l.page_id = ok.page_id WHERE depth < 2 AND hl % 3 <> 2""",
    oc="""SELECT task_id, count(DISTINCT link) FILTER (WHERE NOT known) AS enqueued,
                 count(*) - count(DISTINCT link) FILTER (WHERE NOT known) AS duplicated
          FROM (SELECT *, link IN (SELECT url FROM j WHERE j.task_id = o.task_id) AS known FROM o) GROUP BY task_id""",
)


@query(
    "x16_crawl_step_counters",
    _STEP
    + """SELECT f.task_id, count(*) FILTER (NOT skip AND status IS NOT NULL) AS crawled,
                count(*) FILTER (NOT skip AND (status IS NULL OR status = 503)) AS failed,
                CAST(coalesce(sum(CASE hl % 3 WHEN 1 THEN n_links ELSE 1 END) FILTER (NOT skip AND status = 200), 0) AS BIGINT) AS results,
                count(*) FILTER (skip) AS robots_skip, coalesce(max(oc.enqueued), 0) AS enqueued,
                coalesce(max(oc.duplicated), 0) AS duplicated
         FROM f LEFT JOIN oc ON oc.task_id = f.task_id GROUP BY f.task_id""",
)
def crawl_step_counters(t):
    step, jobs = _step(t)
    return step.counters(jobs.select("task_id", canonical_url(F.col("url")).alias("url")))


@query("x16_crawl_step_offers", _STEP + "SELECT task_id, link AS url, count(*) AS offered FROM o GROUP BY 1, 2")
def crawl_step_offers(t):
    step, _ = _step(t)
    return step.offers.groupBy("task_id", "url").agg(F.count(F.lit(1)).alias("offered"))


# Induction ------------------------------------------------------------------------------------


def _clicks(t, tag: str):
    """First element of a tag on every page, as a click."""
    nodes = extract.dom_nodes(extract.with_dom(t.pages), with_text=False)
    return nodes.filter(F.col("tag") == tag).groupBy("page_id").agg(F.min("node_id").alias("node_id"))


@query(
    "a9_selector_hits",
    """SELECT page_id, 'div.ad' AS expr, len(regexp_extract_all(html, '<div class="ad">')) AS hits,
              len(regexp_extract_all(html, '<div class="ad">')) = 1 AS "unique" FROM pages""",
)
def selector_hits(t):
    return induction.selector_hits(extract.dom_nodes(extract.with_dom(t.pages), with_text=False))


@query(
    "a9_count_css",
    with_tables("page_parts") + "SELECT page_id, len(hrefs) + 1 AS hits FROM page_parts",
    hits="INTEGER",
)
def count_css(t):
    return induction.count_css(extract.with_dom(t.pages), css_plan_lit("nav > ul li:nth-child(n+1) a, body > div.ad"))


@query(
    "a10_navigation_clusters",
    with_tables("page_parts")
    + "SELECT page_id, 'li||a' AS signature, len(hrefs) AS siblings FROM page_parts WHERE len(hrefs) >= 3",
)
def navigation_clusters(t):
    clusters = induction.sibling_clusters(extract.with_dom(t.pages))
    return clusters.filter("signature = 'li||a'").select("page_id", "signature", "siblings")


@query("a10_sibling_clusters")
def sibling_clusters(t):
    return induction.sibling_clusters(extract.with_dom(t.pages))


@query(
    "x11_absolute_xpath",
    with_tables("page_parts")
    + """SELECT page_id, unnest(list_concat(['/body/article/h1', '/body/nav/ul', '/body/div'],
                CASE WHEN len(hrefs) = 1 THEN ['/body/nav/ul/li']
                     ELSE list_transform(range(1, len(hrefs) + 1), lambda i: '/body/nav/ul/li[' || CAST(i AS VARCHAR) || ']') END)) AS xpath
         FROM page_parts""",
)
def absolute_xpath(t):
    nodes = F.col("dom.nodes")
    wanted = F.filter(nodes, lambda n: n["tag"].isin("h1", "ul", "div", "li"))
    paths = F.transform(wanted, lambda n: induction.absolute_xpath(nodes, n))
    return extract.with_dom(t.pages).select("page_id", F.explode(paths).alias("xpath"))


@query(
    "x12_candidates",
    with_tables("page_parts")
    + """SELECT page_id, 'xpath' AS kind, '//body[1]/article[1]/h1[1]' AS expr, true AS "unique", round(0.71, 6) AS score FROM page_parts
         UNION ALL SELECT page_id, 'css', 'body:nth-child(2) > article:nth-child(3) > h1:nth-child(1)', true, 0.5 FROM page_parts""",
    score="DOUBLE",
)
def heading_candidates(t):
    """Candidates for the heading of every page: no ids or classes, so the two positional paths."""
    found = induction.infer_candidates(t.pages, _clicks(t, "h1")).select("page_id", F.explode("candidates").alias("c"))
    return found.select("page_id", "c.kind", "c.expr", "c.unique", F.round("c.score", 6).alias("score"))


@query(
    "x13_list_rules",
    with_tables("page_parts")
    + """SELECT page_id, CASE WHEN len(hrefs) >= 3 THEN 'li' ELSE '' END AS item_selector, 'a' AS field_selector,
                CASE WHEN len(hrefs) >= 3 THEN len(hrefs) ELSE 1 END AS hits FROM page_parts""",
    hits="INTEGER",
)
def list_rules(t):
    """A click on the first navigation link generalises to all of them."""
    return induction.infer_list_rules(t.pages, _clicks(t, "a")).select("page_id", "list_rule.*")
