"""Rule-driven extraction: items, fields and links of pages.

A page is one row with its elements as an array; rules are rows too. Pages are shredded before they
meet the rules, and scoping an item is a slice of that array, so extraction needs no shuffle at all:
the only exchange is the join that brings a rule to its pages, and a small rules side removes it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.selectors import css_plan_lit, rule_plan, rule_plan_lit, select_nodes, select_sql
from webloom.functions.text import head_bytes, squeeze
from webloom.functions.text import let as let_column
from webloom.functions.urls import apply_sql, is_http_sql, let, resolve_sql, trim_sql
from webloom.sources.htmltree import shred

BODY_CAP = 4 * 1024 * 1024


def cap_body(html: Column) -> Column:
    """At most 4 MiB of a body, counted in bytes."""
    return F.when(F.octet_length(html) > BODY_CAP, head_bytes(html, BODY_CAP)).otherwise(html)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input as many tasks as there are cores; large inputs keep their file splits.

    Decided by the planner's size estimate, without running anything: an input below one split per
    core is cheap to move, and parsing it is not.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if estimated_bytes(df) < cores * split else df


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate; it comes from file sizes and runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def with_dom(pages: DataFrame, with_html: bool = False) -> DataFrame:
    """Pages plus column ``dom`` = STRUCT<nodes, text, html> (X1, one row per page)."""
    return spread(pages).withColumn("dom", shred(cap_body(F.col("html")), with_html))


NODE_TEXT = 80
_HEAD = 1000


def _node_text(page_text: Column, n: Column) -> Column:
    """First 80 characters of a node's text, white space squeezed. The text of an outer node is the
    whole page, so its head is squeezed first and the rest only if the head is nearly blank."""
    span = n["t1"] - n["t0"]

    def squeezed(length: Column) -> Column:
        return squeeze(F.substring(page_text, n["t0"] + 1, length))

    def enough(head: Column) -> Column:
        done = (span <= _HEAD) | (F.length(head) > NODE_TEXT)
        return F.substring(F.when(done, head).otherwise(squeezed(span)), 1, NODE_TEXT)

    return let_column(squeezed(F.least(span, F.lit(_HEAD))), enough)


def dom_nodes(doms: DataFrame, with_text: bool = True) -> DataFrame:
    """The node table: one row per listed element, ids in document order.

    The rows of a page are held together when they are exploded, so none carries the page: texts are cut inside the
    array. ``with_text`` False leaves out column ``text``, which the optimizer cannot drop from there.
    """
    n, nodes = F.col("n"), F.col("dom.nodes")
    if with_text:
        nodes = F.transform(
            F.filter(nodes, lambda x: x["node_id"] > 0), lambda x: x.withField("text", _node_text(F.col("dom.text"), x))
        )
    # Outer, so that the optimizer does not work out the texts once more to ask whether there are any.
    return (
        doms.select("page_id", F.explode_outer(nodes).alias("n"))
        .filter(n["node_id"] > 0)
        .select(
            "page_id",
            *[n[c].alias(c) for c in ("node_id", "end_id", "parent_id", "tag", "id_attr", "classes", "attrs", "own_text")],
            *[n[c].alias(c) for c in ["text"] * with_text],
            *[n[c].alias(c) for c in ("sib_idx", "type_idx", "n_type", "depth", "path", "pos")],
        )
    )


def _piece(text: str, node: str, span: str) -> str:
    return f"substring({text}, {node}.{span}0 + 1, {node}.{span}1 - {node}.{span}0)"


# SQL texts over p = STRUCT<dom, html, url, plan> of a page. Building them as text keeps the driver's
# share small; Spark sees ordinary expressions.
_NO_CONTEXT = "cast(NULL AS int)"


def _select(nodes: str, alts: str, below: str, context: str) -> str:
    query = f"'nodes', {nodes}, 'alts', {alts}, 'below', {below}, 'context', {context}, 'text', p.dom.text"
    return select_sql(f"named_struct({query})")


# A scope (X2) is a match of the item selector, cut out of the page's elements (J5), or the page.
_PAGE_SCOPE = (
    "named_struct('nodes', p.dom.nodes, 'below', 0, 'text', p.dom.text, 'source', p.html, 'whole', true)"
)
_ITEM_SCOPE = f"""named_struct('nodes', slice(p.dom.nodes, it.pos, it.end_pos - it.pos + 1), 'below', it.pos - 1,
    'text', {_piece("p.dom.text", "it", "t")}, 'source', {_piece("p.dom.html", "it", "o")}, 'whole', false)"""
_SCOPES = f"""CASE WHEN p.plan.whole THEN array({_PAGE_SCOPE})
    ELSE transform({_select("p.dom.nodes", "p.plan.items", "0", _NO_CONTEXT)}, it -> {_ITEM_SCOPE}) END"""

# What a match yields, by the attr of the field (X6). The attributes in the list are
# read without falling back to the text.
_VALUE = f"""CASE
    WHEN startswith(f.take, '@') THEN hit.attrs[substring(f.take, 2)]
    WHEN f.take = 'text()' THEN hit.own_text
    WHEN f.attr IN ('', 'text') THEN {_piece("p.dom.text", "hit", "t")}
    WHEN f.attr = 'html' THEN {_piece("p.dom.html", "hit", "i")}
    WHEN f.kind = 'css' AND f.attr IN ('href', 'src', 'content', 'value', 'title', 'alt') THEN hit.attrs[f.attr]
    ELSE coalesce(hit.attrs[f.attr], {_piece("p.dom.text", "hit", "t")}) END"""

# One field in one scope: CSS (X3) and XPath (X4) take the first match, regex (X5) reads the scope's
# text or source. XPath starts from the item itself, or from the document of a whole page.
_CONTEXT = "CASE WHEN f.kind = 'xpath' THEN if(sc.whole, 0, 1) END"
_WANTED = f"""filter({_select("sc.nodes", "f.alts", "sc.below", _CONTEXT)},
    w -> NOT startswith(f.take, '@') OR w.attrs[substring(f.take, 2)] IS NOT NULL)"""
_BY_NODE = let(f"try_element_at({_WANTED}, 1)", "hit", _VALUE)
_BY_REGEX = f"regexp_extract(if(f.attr = 'html', sc.source, {trim_sql('sc.text')}), f.pattern, f.group)"
_FIELD = f"CASE WHEN f.error != '' THEN '' WHEN f.kind = 'regex' THEN {_BY_REGEX} ELSE {_BY_NODE} END"
_FIELD = trim_sql(f"coalesce({_FIELD}, '')")

# Items (X7): a payload per scope; broken fields add <name>_error.
_PAYLOAD = f"""map_from_entries(concat(
    transform(p.plan.fields, f -> named_struct('key', f.name, 'value', {_FIELD})),
    transform(filter(p.plan.fields, f -> f.error != ''),
              f -> named_struct('key', concat(f.name, '_error'), 'value', f.error))))"""
_ITEMS = f"""p -> CASE WHEN size(p.plan.fields) = 0 THEN cast(array() AS array<map<string,string>>)
    ELSE transform({_SCOPES}, sc -> {_PAYLOAD}) END"""

_LINKS = f"""p -> array_distinct(filter(
    transform({_select("p.dom.nodes", "p.alts", "0", _NO_CONTEXT)},
              hit -> {resolve_sql("p.url", "coalesce(hit.attrs['href'], '')")}),
    l -> l != '' AND {is_http_sql("l")}))"""


def page_items(dom: Column, html: Column, plan: Column) -> Column:
    """ARRAY<MAP<STRING,STRING>>: one payload per item (X7); no usable field, no items."""
    return apply_sql(F.struct(dom.alias("dom"), html.alias("html"), plan.alias("plan")), _ITEMS)


def page_links(dom: Column, url: Column, alts: Column) -> Column:
    """Distinct absolute http links of a page in document order."""
    return apply_sql(F.struct(dom.alias("dom"), url.alias("url"), alts.alias("alts")), _LINKS)


def extract(doms: DataFrame, plan: Column) -> DataFrame:
    """Adds ``items``, ``links`` and ``rule_error`` to shredded pages; ``plan`` is a column or a literal rule.

    ``rule_error`` names item and link selectors that could not be read ('' if all could).
    """
    return (
        doms.withColumn("_plan", plan)
        .withColumn("rule_error", F.col("_plan.error"))
        .withColumn("items", page_items(F.col("dom"), F.col("html"), F.col("_plan")))
        .withColumn("links", page_links(F.col("dom"), F.col("url"), F.col("_plan.links")))
        .drop("_plan")
    )


def preview(pages: DataFrame, item_selector: str, link_selector: str, fields: list[dict]) -> DataFrame:
    """One rule on given pages (X9, preview)."""
    html = any((f.get("attr") or "").strip().lower() == "html" for f in fields)
    return extract(with_dom(pages, html), rule_plan_lit(item_selector, link_selector, fields))


def extract_by_rules(pages: DataFrame, rules: DataFrame, on: list[str], with_html: bool = True) -> DataFrame:
    """Many rules over many pages in one pass (X9): the rule of a page is found by the key ``on``.

    Pages are parsed once, whatever the number of their rules. How the rules come to them is left to
    Spark, which knows the measured size of the compiled rules; a hot key is split by the skew join.
    """
    plans = rules.select(
        *on,
        F.col("id").alias("rule_id"),
        rule_plan(F.col("item_selector"), F.col("link_selector"), F.col("fields")).alias("plan"),
    )
    return extract(with_dom(pages, with_html).join(plans, on), F.col("plan")).drop("plan")


def result_rows(extracted: DataFrame, task_id: Column) -> DataFrame:
    """One row per item, its payload stamped with the page URL."""
    return extracted.select(
        task_id.alias("task_id"), "url", F.explode("items").alias("_item")
    ).select(
        "task_id",
        "url",
        F.map_concat(
            F.map_filter("_item", lambda k, _: k != "_url"), F.create_map(F.lit("_url"), F.col("url"))
        ).alias("payload"),
    )


def links_of(doms: DataFrame, selector: str) -> DataFrame:
    """(page_id, url, link) rows of one link selector."""
    links = page_links(F.col("dom"), F.col("url"), css_plan_lit(selector))
    return doms.select("page_id", "url", F.explode(links).alias("link"))
