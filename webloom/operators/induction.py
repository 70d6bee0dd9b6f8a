"""Wrapper induction: selector candidates, their hits and scores, list rules.

A click names one element of one page. All the work on it happens inside the page row, with the same
matcher that extraction uses, so a candidate's hit count is by construction what extraction would
find. Page-wide keyed counts and sibling clusters are plain aggregations of the node table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.selectors import BARRED, HAS, STEP, select_nodes
from webloom.functions.text import candidate_score, is_safe_ident, let
from webloom.operators.extract import with_dom

MAX_CANDIDATES, MAX_SEGMENTS, MIN_SIBLINGS = 8, 8, 3
# Attributes that may be combined with the tag.
COMBINED = ("name", "type", "role", "itemprop")
_ATTRS = "array<struct<name:string,op:string,value:string>>"
_NTH = "array<struct<of:string,a:int,b:int>>"
_TEXTS = "array<struct<own:boolean,op:string,value:string>>"
_CANDIDATE = f"struct<kind:string,expr:string,steps:array<{STEP}>>"


def _concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def first_class(n: Column) -> Column:
    """First class of a node when it can be written without quoting, else ''."""
    c = F.coalesce(F.get(n["classes"], F.lit(0)), F.lit(""))
    return F.when(is_safe_ident(c), c).otherwise("")


def signature(n: Column) -> Column:
    """Shape of a node: tag, first class, and tag and first class of each child (A10)."""
    return _concat(n["tag"], "|", F.coalesce(F.get(n["classes"], F.lit(0)), F.lit("")), "|", n["child_sig"])


# Whole-table aggregations -------------------------------------------------------------------------


def selector_hits(nodes: DataFrame) -> DataFrame:
    """How many nodes of a page each simple selector matches: #id, [data-x='v'], tag.class.

    Every node states the selectors it satisfies, so all counts of all pages come from one
    aggregation and no page is scanned once per candidate.
    """
    by_id = F.when(F.col("id_attr") != "", F.array(_concat("#", F.col("id_attr"))))
    data = F.filter(F.map_entries("attrs"), lambda e: e["key"].startswith("data-") & (e["value"] != ""))
    by_data = F.transform(data, lambda e: _concat("[", e["key"], "='", e["value"], "']"))
    by_class = F.transform("classes", lambda c: _concat(F.col("tag"), ".", c))
    keys = F.concat(F.coalesce(by_id, F.array().cast("array<string>")), by_data, by_class)
    return (
        nodes.select("page_id", F.explode(keys).alias("expr"))
        .groupBy("page_id", "expr")
        .agg(F.count(F.lit(1)).alias("hits"))
        .withColumn("unique", F.col("hits") == 1)
    )


def sibling_clusters(doms: DataFrame) -> DataFrame:
    """Groups of at least three children of one parent that have the same shape (A10)."""
    n = F.col("n")
    rows = doms.select("page_id", F.explode("dom.nodes").alias("n")).filter(n["node_id"] > 0)
    return (
        rows.groupBy("page_id", n["parent_id"].alias("parent_id"), signature(n).alias("signature"))
        .agg(F.count(F.lit(1)).alias("siblings"), F.min(n["node_id"]).alias("first_node"))
        .filter((F.col("siblings") >= MIN_SIBLINGS) & (F.col("parent_id") > 0))
    )


def sibling_positions(nodes: DataFrame) -> DataFrame:
    """Position among all siblings (from 0) and among those of the same tag (from 1).

    Windows per parent: a page is bounded, so is the longest sibling list.
    """
    order = F.col("node_id")
    among = Window.partitionBy("page_id", "parent_id").orderBy(order)
    same = Window.partitionBy("page_id", "parent_id", "tag").orderBy(order)
    return nodes.select(
        "page_id", "node_id", "parent_id", "tag",
        (F.row_number().over(among) - 1).alias("sib_idx"), F.row_number().over(same).alias("type_idx"),
    )


# Per click ------------------------------------------------------------------------------------


def _chain(nodes: Column, n: Column) -> Column:
    """The node and its ancestors, nearest first, without html."""
    above = F.transform(F.filter(F.reverse(n["path"]), lambda p: p > 0), lambda p: F.try_element_at(nodes, p))
    return F.filter(F.concat(F.array(n), above), lambda x: x["tag"] != "html")


def _until_id(chain: Column, limit: int | None = MAX_SEGMENTS) -> Column:
    """Chain up to and including the nearest node with a usable id, at most ``limit`` long."""
    stops = F.transform(chain, lambda x: is_safe_ident(x["id_attr"]))
    at = F.array_position(stops, True)
    n = F.when(at > 0, at).otherwise(F.size(chain))
    return F.slice(chain, F.lit(1), (F.least(n, F.lit(limit)) if limit else n).cast("int"))


def _step(comb="", tag="", id_="", classes=None, attrs=None, nth=None) -> Column:
    def lit(v):
        return F.lit(v) if isinstance(v, str) else v

    return F.struct(
        lit(comb).alias("comb"),
        lit(tag).alias("tag"),
        lit(id_).alias("id"),
        (classes if classes is not None else F.array().cast("array<string>")).alias("classes"),
        (attrs if attrs is not None else F.array().cast(_ATTRS)).alias("attrs"),
        (nth if nth is not None else F.array().cast(_NTH)).alias("nth"),
        F.array().cast(_TEXTS).alias("texts"),
        F.array().cast(BARRED).alias("barred"),
        F.array().cast(HAS).alias("has"),
    ).cast(STEP)


def _has(name, value: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("name"), F.lit("=").alias("op"), value.alias("value"))


def _nth(of: str, at: Column) -> Column:
    return F.array(F.struct(F.lit(of).alias("of"), F.lit(0).alias("a"), at.cast("int").alias("b"))).cast(_NTH)


def _candidate(kind: str, expr: Column, *steps: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), expr.alias("expr"), F.array(*steps).alias("steps")).cast(_CANDIDATE)


def _class_list(c: Column) -> Column:
    return F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def _by_id(ident: Column) -> Column:
    return _step(" ", attrs=F.array(_has("id", ident)).cast(_ATTRS))


def _css_path(chain: Column) -> Column:
    """nth-child path from the nearest id or the top (at most eight steps)."""

    def seg(x: Column, last: Column) -> Column:
        cls = first_class(x)
        by_id = last & is_safe_ident(x["id_attr"])
        text = (
            F.when(by_id, _concat("#", x["id_attr"]))
            .when(cls != "", _concat(x["tag"], ".", cls))
            .otherwise(_concat(x["tag"], ":nth-child(", (x["sib_idx"] + 1).cast("string"), ")"))
        )
        comb = F.when(last, "").otherwise(">")
        # Positions of a written path count listed siblings; the matcher counts every element.
        step = F.when(by_id, _step(comb, id_=x["id_attr"])).when(
            cls != "", _step(comb, x["tag"], classes=_class_list(cls))
        ).otherwise(_step(comb, x["tag"], nth=_nth("child", x["sib_idx"] + 1)))
        return F.struct(text.alias("text"), step.alias("step"))

    return _path(chain, seg, "css", "", " > ")


def _x_path(chain: Column) -> Column:
    """Positional path; positions count siblings of the same tag."""

    def seg(x: Column, last: Column) -> Column:
        by_id = last & is_safe_ident(x["id_attr"])
        text = F.when(by_id, _concat("*[@id='", x["id_attr"], "']")).otherwise(
            _concat(x["tag"], "[", x["type_idx"].cast("string"), "]")
        )
        comb = F.when(last, " ").otherwise(">")
        step = F.when(by_id, _step(comb, attrs=F.array(_has("id", x["id_attr"])).cast(_ATTRS))).otherwise(
            _step(comb, x["tag"], nth=_nth("of-type", x["type_idx"]))
        )
        return F.struct(text.alias("text"), step.alias("step"))

    return _path(chain, seg, "xpath", "//", "/")


def _path(chain: Column, seg, kind: str, lead: str, sep: str) -> Column:
    cut = _until_id(chain)
    top = let(cut, lambda c: F.reverse(F.transform(c, lambda x, i: seg(x, i == F.size(c) - 1))))
    return let(
        top,
        lambda s: F.struct(
            F.lit(kind).alias("kind"),
            _concat(lead, F.array_join(F.transform(s, lambda p: p["text"]), sep)).alias("expr"),
            F.transform(s, lambda p: p["step"]).alias("steps"),
        ).cast(_CANDIDATE),
    )


def candidates(nodes: Column, n: Column) -> Column:
    """ARRAY of selector candidates of a node in order of preference (X10), distinct."""
    none = F.array().cast(f"array<{_CANDIDATE}>")
    ident, tag = n["id_attr"], n["tag"]
    by_id = F.when(
        is_safe_ident(ident),
        F.array(
            _candidate("css", _concat("#", ident), _step(id_=ident)),
            _candidate("xpath", _concat("//*[@id='", ident, "']"), _by_id(ident)),
        ),
    ).otherwise(none)

    data = F.filter(
        F.map_entries(n["attrs"]),
        lambda e: e["key"].startswith("data-") & (e["value"] != "") & ~e["value"].rlike("['\"]"),
    )

    def of_data(e: Column) -> Column:
        test = F.array(_has(e["key"], e["value"])).cast(_ATTRS)
        return F.array(
            _candidate("css", _concat("[", e["key"], "='", e["value"], "']"), _step(attrs=test)),
            _candidate("xpath", _concat("//*[@", e["key"], "='", e["value"], "']"), _step(" ", attrs=test)),
        )

    by_data = F.flatten(F.transform(data, of_data))
    by_class = F.transform(
        F.filter(n["classes"], is_safe_ident),
        lambda c: _candidate("css", _concat(tag, ".", c), _step(tag=tag, classes=F.array(c))),
    )
    cls = first_class(n)

    def below(parent: Column) -> Column:
        pid = parent["id_attr"]
        field = F.when(cls != "", _step(" ", classes=_class_list(cls))).otherwise(_step(" ", tag))
        text = F.when(cls != "", _concat(".", cls)).otherwise(tag)
        return F.when(
            is_safe_ident(pid),
            F.array(
                _candidate("css", _concat("#", pid, " ", text), _step(id_=pid), field),
                _candidate("xpath", _concat("//*[@id='", pid, "']//", tag), _by_id(pid), _step(" ", tag)),
            ),
        ).otherwise(none)

    by_parent = F.coalesce(let(F.try_element_at(nodes, F.nullif(n["parent_pos"], F.lit(0))), below), none)
    tests = F.filter(
        F.array(*[_has(k, F.element_at(n["attrs"], k)) for k in COMBINED]),
        lambda t: F.coalesce((t["value"] != "") & ~t["value"].rlike("['\" ]"), F.lit(False)),
    )

    def combo(found: Column) -> Column:
        tail = F.array_join(F.transform(found, lambda t: _concat("[", t["name"], "='", t["value"], "']")), "")
        head = F.when(cls != "", _concat(tag, ".", cls)).otherwise(tag)
        step = _step(tag=tag, classes=_class_list(cls), attrs=found.cast(_ATTRS))
        return F.when(F.size(found) > 0, F.array(_candidate("css", _concat(head, tail), step))).otherwise(none)

    paths = let(_chain(nodes, n), lambda c: F.array(_css_path(c), _x_path(c)))
    return F.array_distinct(F.concat(by_id, by_data, by_class, by_parent, let(tests, combo), paths))


def ranked_candidates(nodes: Column, n: Column) -> Column:
    """The best eight candidates with hits, uniqueness and score."""

    def scored(c: Column, i: Column) -> Column:
        context = F.when(c["kind"] == "xpath", F.lit(0))
        hits = F.size(select_nodes(nodes, F.array(c["steps"]), F.lit(0), context))
        return F.struct(c.alias("c"), hits.alias("hits"), i.alias("i"))

    def ranked(s: Column) -> Column:
        score = candidate_score(s["c"]["kind"], s["c"]["expr"], s["hits"])
        return F.struct(
            (-score).alias("neg"),
            F.octet_length(s["c"]["expr"]).alias("len"),
            s["i"].alias("i"),
            s["c"]["kind"].alias("kind"),
            s["c"]["expr"].alias("expr"),
            s["hits"].alias("hits"),
            (s["hits"] == 1).alias("unique"),
            score.alias("score"),
        )

    rows = F.array_sort(F.transform(F.transform(candidates(nodes, n), scored), ranked))
    return F.transform(
        F.slice(rows, 1, MAX_CANDIDATES),
        lambda r: F.struct(r["kind"], r["expr"], r["unique"], r["score"], r["hits"]),
    )


def absolute_xpath(nodes: Column, n: Column) -> Column:
    """Path from the root or the nearest id, with positions only where a tag repeats (X11)."""

    def seg(x: Column, last: Column) -> Column:
        return (
            F.when(last & is_safe_ident(x["id_attr"]), _concat("*[@id='", x["id_attr"], "']"))
            .when(x["n_type"] > 1, _concat(x["tag"], "[", x["type_idx"].cast("string"), "]"))
            .otherwise(x["tag"])
        )

    def joined(c: Column) -> Column:
        segs = F.transform(c, lambda x, i: seg(x, i == F.size(c) - 1))
        return _concat("/", F.array_join(F.reverse(segs), "/"))

    own = _concat("//*[@id='", n["id_attr"], "']")
    return F.when(is_safe_ident(n["id_attr"]), own).otherwise(let(_until_id(_chain(nodes, n), None), joined))


def _matches(n: Column, kind: Column, value: Column) -> Column:
    return (
        F.when(kind == ".", F.array_contains(n["classes"], value))
        .when(kind == "#", n["id_attr"] == value)
        .otherwise(n["tag"] == value)
    )


def _selector(kind, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def list_rule(nodes: Column, n: Column) -> Column:
    """STRUCT<item_selector, field_selector, hits> that repeats a click over a list.

    Every ancestor with at least two look-alike siblings is tried; most hits win, then the nearest.
    """
    chain = F.filter(_chain(nodes, n), lambda x: x["tag"] != "body")

    def repeats(x: Column) -> Column:
        mine = signature(x)
        twins = F.filter(nodes, lambda s: (s["parent_pos"] == x["parent_pos"]) & (s["node_id"] > 0) & (signature(s) == mine))
        return (x["parent_id"] > 0) & (F.size(twins) >= MIN_SIBLINGS)

    def item_of(x: Column) -> Column:
        cls = first_class(x)
        return (
            F.when(cls != "", _selector(".", cls))
            .when(is_safe_ident(x["id_attr"]), _selector("#", x["id_attr"]))
            .otherwise(_selector("", x["tag"]))
        )

    def field_of(x: Column, upto: Column) -> Column:
        own = F.coalesce(F.get(n["classes"], F.lit(0)), F.lit(""))
        # Classes from the click up to, but not including, the item.
        inner = F.filter(F.transform(F.slice(chain, F.lit(1), upto), first_class), lambda c: c != "")
        near = F.coalesce(F.try_element_at(inner, F.lit(1)), F.lit(""))
        itself = F.when(own != "", _selector(".", own)).otherwise(_selector("", n["tag"]))
        inside = F.when(near != "", _selector(".", near)).otherwise(_selector("", n["tag"]))
        return F.when(upto == 0, itself).otherwise(inside)

    def hits(item: Column, field: Column) -> Column:
        def has_field(x: Column) -> Column:
            under = F.slice(nodes, x["pos"] + 1, x["end_pos"] - x["pos"])
            return F.exists(under, lambda d: _matches(d, field["kind"], field["value"]))

        return F.size(F.filter(nodes, lambda x: _matches(x, item["kind"], item["value"]) & has_field(x)))

    def rule(x: Column, i: Column) -> Column:
        pair = F.struct(item_of(x).alias("item"), field_of(x, i).alias("field"))
        found = let(pair, lambda p: F.struct(p["item"].alias("item"), p["field"].alias("field"), hits(p["item"], p["field"]).alias("hits")))
        return F.when(repeats(x), found)

    rules = F.filter(F.transform(chain, rule), lambda r: F.coalesce(r["hits"] > 0, F.lit(False)))
    best = F.aggregate(
        rules,
        F.try_element_at(rules, F.lit(1)),
        lambda a, r: F.when(r["hits"] > a["hits"], r).otherwise(a),
    )

    def text(s: Column) -> Column:
        return _concat(s["kind"], s["value"])

    cls = first_class(n)
    fallback = F.struct(
        F.lit("").alias("item_selector"),
        F.when(cls != "", _concat(".", cls)).otherwise(n["tag"]).alias("field_selector"),
        F.lit(1).alias("hits"),
    )
    return let(
        best,
        lambda b: F.when(b.isNull(), fallback).otherwise(
            F.struct(text(b["item"]).alias("item_selector"), text(b["field"]).alias("field_selector"), b["hits"].alias("hits"))
        ),
    )


def clicked_nodes(pages: DataFrame, clicks: DataFrame) -> DataFrame:
    """page_id, dom and the clicked element ``n`` of every click. ``clicks``: page_id, node_id.

    Clicks are gathered per page first (distinct nodes of one bounded page), so a page meets its
    clicks once, however many there are. They meet the raw page: only clicked pages are parsed, and
    page text is moved rather than its elements.
    """
    per_page = clicks.groupBy("page_id").agg(F.collect_set("node_id").alias("_clicked"))
    doms = with_dom(pages.select("page_id", "html").join(per_page, "page_id"))
    hit = F.filter(
        F.col("dom.nodes"), lambda n: (n["node_id"] > 0) & F.array_contains(F.col("_clicked"), n["node_id"])
    )
    return doms.select("page_id", "dom", F.explode(hit).alias("n"))


def infer_candidates(pages: DataFrame, clicks: DataFrame) -> DataFrame:
    """Ranked selector candidates of every click."""
    found = ranked_candidates(F.col("dom.nodes"), F.col("n")).alias("candidates")
    return clicked_nodes(pages, clicks).select("page_id", F.col("n.node_id").alias("node_id"), found)


def infer_list_rules(pages: DataFrame, clicks: DataFrame) -> DataFrame:
    """List rule of every click."""
    found = list_rule(F.col("dom.nodes"), F.col("n")).alias("list_rule")
    return clicked_nodes(pages, clicks).select("page_id", F.col("n.node_id").alias("node_id"), found)


def infer(pages: DataFrame, clicks: DataFrame) -> DataFrame:
    """Candidates and list rule of every click."""
    nodes, n = F.col("dom.nodes"), F.col("n")
    return clicked_nodes(pages, clicks).select(
        "page_id",
        n["node_id"].alias("node_id"),
        ranked_candidates(nodes, n).alias("candidates"),
        list_rule(nodes, n).alias("list_rule"),
    )


def count_css(doms: DataFrame, plan: Column) -> DataFrame:
    """Number of elements of each page that a selector matches."""
    hits = F.size(select_nodes(F.col("dom.nodes"), plan, F.lit(0), F.lit(None).cast("int"), F.col("dom.text")))
    return doms.select("page_id", hits.alias("hits"))


def list_hits(doms: DataFrame, item: Column, field: Column) -> DataFrame:
    """Number of items of each page that hold at least one match of the field selector."""
    nodes = F.col("dom.nodes")
    none = F.lit(None).cast("int")

    def holds(x: Column) -> Column:
        under = F.slice(nodes, x["pos"] + 1, x["end_pos"] - x["pos"])
        return F.size(select_nodes(under, field, x["pos"], none)) > 0

    items = F.filter(select_nodes(nodes, item, F.lit(0), none), holds)
    return doms.select("page_id", F.size(items).alias("hits"))
