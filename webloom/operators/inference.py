"""Wrapper induction over whole pages: candidates and list rules of every element.

``induction`` answers for a click, by running the matcher over the page once for each candidate. For all elements of
a page that would be a scan of the page for each of its candidates. Here the work is turned round:

* Every element states the selectors that it satisfies (id, class, tag, attribute tests, descendant of an id). One
  count of what is stated gives the hits of all such candidates of all elements.
* Paths are followed from their first step, all paths of a page together: a prefix that many paths share is reached
  once, and a step is a join of the elements reached with those that have them as parent and satisfy the step.
* "An item that holds a field" is a question of intervals of the document order: the next field after an item's start
  must not lie beyond its end. Items and fields of a pair are read in one pass over a window.

All tables are keyed by page and selector, so a large page is spread over tasks, too. Both sides of every join grow with
the pages. Their sizes are estimated from small files with arrays, before the arrays are exploded, so without a hint
Spark broadcasts sides that fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import candidate_score, is_safe_ident, let
from webloom.operators.extract import with_dom
from webloom.operators.induction import (
    COMBINED,
    MAX_CANDIDATES,
    MAX_SEGMENTS,
    MIN_SIBLINGS,
    _chain,
    _concat,
    candidates,
    first_class,
    signature,
)
from webloom.session import cut_lineage

_TEXTS = "array<string>"
_MERGE = "merge"  # both sides are shuffled; skewed keys are still split


def _test(name, value: Column) -> Column:
    return _concat("[", name, "='", value, "']")


def _under(head: Column, c: Column) -> Column:
    return _concat(head, ".", c)


def stated(nodes: Column, n: Column) -> Column:
    """ARRAY of the selectors that an element satisfies, of the shapes that candidates and list rules have."""
    none, tag, classes = F.array().cast(_TEXTS), n["tag"], n["classes"]
    own_id = F.when(n["id_attr"] != "", F.array(_concat("#", n["id_attr"]))).otherwise(none)
    data = F.filter(F.map_entries(n["attrs"]), lambda e: e["key"].startswith("data-") & (e["value"] != ""))
    by_data = F.transform(data, lambda e: _test(e["key"], e["value"]))
    heads = F.concat(F.array(tag), F.transform(classes, lambda c: _under(tag, c)))
    # All combinations of the attributes that may be combined: at most 15, in their fixed order.
    tests = F.filter(F.array(*[_test(k, F.element_at(n["attrs"], k)) for k in COMBINED]), lambda t: t.isNotNull())
    combined = F.aggregate(tests, F.array(F.lit("")), lambda acc, t: F.concat(acc, F.transform(acc, lambda s: F.concat(s, t))))
    by_tests = F.flatten(F.transform(heads, lambda h: F.transform(F.filter(combined, lambda s: s != ""), lambda s: F.concat(h, s))))
    above = F.transform(F.filter(n["path"], lambda p: p > 0), lambda p: F.try_element_at(nodes, p)["id_attr"])
    ids = F.array_distinct(F.filter(above, lambda v: v != ""))
    scoped = F.flatten(
        F.transform(ids, lambda v: F.concat(F.array(_concat("#", v, " ", tag)), F.transform(classes, lambda c: _concat("#", v, " .", c))))
    )
    return F.concat(own_id, by_data, heads, F.transform(classes, lambda c: _concat(".", c)), by_tests, scoped)


def path_steps(n: Column) -> Column:
    """ARRAY of the steps of a path that an element satisfies."""
    by_id = F.when(n["id_attr"] != "", F.array(_concat("#", n["id_attr"]))).otherwise(F.array().cast(_TEXTS))
    nth = F.array(_concat(n["tag"], ":nth-child(", n["el_idx"].cast("string"), ")"), _concat(n["tag"], "[", n["type_idx"].cast("string"), "]"))
    return F.concat(by_id, F.transform(n["classes"], lambda c: _under(n["tag"], c)), nth)


def _step_text(st: Column) -> Column:
    """A step of a candidate as one of the texts above."""
    attr, nth = F.get(st["attrs"], F.lit(0)), F.get(st["nth"], F.lit(0))
    at = nth["b"].cast("string")
    return (
        F.when(st["id"] != "", _concat("#", st["id"]))
        .when(attr["name"] == "id", _concat("#", attr["value"]))
        .when(attr.isNotNull(), _test(attr["name"], attr["value"]))
        .when(F.size(st["classes"]) > 0, _under(st["tag"], st["classes"][0]))
        .when(nth["of"] == "child", _concat(st["tag"], ":nth-child(", at, ")"))
        .when(nth.isNotNull(), _concat(st["tag"], "[", at, "]"))
        .otherwise(st["tag"])
    )


def _wanted(c: Column, i: Column) -> Column:
    """A candidate with the selector whose hits it has, or the steps of its path."""
    texts = F.transform(c["steps"], _step_text)
    path = F.coalesce(F.get(c["steps"], F.lit(1))["comb"] == ">", F.lit(False))
    key = F.when(c["kind"] == "css", c["expr"]).otherwise(F.array_join(texts, " "))
    return F.struct(
        i.alias("i"), c["kind"].alias("kind"), c["expr"].alias("expr"), F.when(~path, key).alias("key"), F.when(path, texts).alias("path")
    )


def _rules(nodes: Column, n: Column) -> Column:
    """For an element and each ancestor below the body: the ancestor as item, and the field inside it."""
    chain = F.filter(_chain(nodes, n), lambda x: x["tag"] != "body")

    def rule(c: Column, x: Column, i: Column) -> Column:
        cls, own = first_class(x), F.coalesce(F.get(n["classes"], F.lit(0)), F.lit(""))
        item = F.when(cls != "", _concat(".", cls)).when(is_safe_ident(x["id_attr"]), _concat("#", x["id_attr"])).otherwise(x["tag"])
        near = F.try_element_at(F.filter(F.transform(F.slice(c, F.lit(1), i), first_class), lambda v: v != ""), F.lit(1))
        field = F.when(i > 0, near).otherwise(F.nullif(own, F.lit("")))
        return F.struct(i.alias("i"), x["pos"].alias("pos"), item.alias("item"), F.coalesce(_concat(".", field), n["tag"]).alias("field"))

    return let(chain, lambda c: F.transform(c, lambda x, i: rule(c, x, i)))


def page_elements(pages: DataFrame) -> DataFrame:
    """Elements of all pages with what they state and what is asked about them; written once, pages are parsed once."""
    nodes, n = F.col("dom.nodes"), F.col("n")
    rows = with_dom(pages.select("page_id", "html")).select("page_id", "dom", F.explode(nodes).alias("n"))
    cls, listed = first_class(n), n["node_id"] > 0
    return cut_lineage(
        rows.select(
            "page_id", *[n[c].alias(c) for c in ("pos", "end_pos", "parent_pos", "node_id", "parent_id")], signature(n).alias("signature"),
            F.array_distinct(stated(nodes, n)).alias("stated"), F.array_distinct(path_steps(n)).alias("steps"),
            F.when(listed, F.transform(candidates(nodes, n), _wanted)).alias("wanted"), F.when(listed, _rules(nodes, n)).alias("rules"),
            F.when(cls != "", _concat(".", cls)).otherwise(n["tag"]).alias("itself"),
        )
    )


def stated_hits(elements: DataFrame) -> DataFrame:
    """(page_id, key, hits) of every selector that some element states."""
    keys = F.array_distinct(F.concat("stated", "steps"))
    return elements.select("page_id", F.explode(keys).alias("key")).groupBy("page_id", "key").agg(F.count("*").alias("hits"))


def path_hits(elements: DataFrame, paths: DataFrame) -> DataFrame:
    """(page_id, path, hits) of (page_id, path) with a path as its steps; prefixes are reached once for all paths."""
    steps = elements.select("page_id", "pos", "parent_pos", F.explode("steps").alias("step"))
    paths, found, reached = paths.distinct(), [], None
    for size in range(1, MAX_SEGMENTS + 1):
        prefix = paths.filter(F.size("path") >= size).select("page_id", F.slice("path", 1, size).alias("path")).distinct()
        prefix = prefix.withColumn("step", F.element_at("path", -1)).withColumn("up", F.slice("path", 1, size - 1) if size > 1 else F.array().cast(_TEXTS))
        if reached is None:
            now = prefix.join(steps.hint(_MERGE), ["page_id", "step"])
        else:
            above = reached.select("page_id", F.col("path").alias("up"), F.col("pos").alias("parent_pos"))
            now = prefix.join(above.hint(_MERGE), ["page_id", "up"]).join(steps.hint(_MERGE), ["page_id", "parent_pos", "step"])
        reached = cut_lineage(now.select("page_id", "path", "pos"))
        if reached.isEmpty():
            break
        found.append(reached.groupBy("page_id", "path").agg(F.count("*").alias("hits")))
    out = found[0] if found else paths.withColumn("hits", F.lit(0).cast("bigint")).limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def page_candidates(elements: DataFrame) -> DataFrame:
    """The best eight selectors of every listed element (X12): page_id, node_id, rank, kind, expr, unique, score, hits."""
    rows = elements.select("page_id", "node_id", F.explode("wanted").alias("c")).select("page_id", "node_id", "c.*")
    simple = rows.filter("path IS NULL").join(stated_hits(elements).hint(_MERGE), ["page_id", "key"], "left")
    long = rows.filter("path IS NOT NULL")
    long = long.join(path_hits(elements, long.select("page_id", "path")).hint(_MERGE), ["page_id", "path"], "left")
    # No element states the empty selector, that of the html element, which has no path.
    columns = ["page_id", "node_id", "i", "kind", "expr", F.coalesce("hits", F.lit(0)).cast("int").alias("hits")]
    scored = simple.select(*columns).unionByName(long.select(*columns))
    scored = scored.withColumn("score", candidate_score(F.col("kind"), F.col("expr"), F.col("hits")))
    order = Window.partitionBy("page_id", "node_id").orderBy(F.desc("score"), F.octet_length("expr"), "i")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_CANDIDATES)
    return ranked.select("page_id", "node_id", "rank", "kind", "expr", (F.col("hits") == 1).alias("unique"), "score", "hits")


def items_holding(elements: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, item, field, hits): items of each page that hold a field, for pairs of selectors."""
    stated_ = elements.select("page_id", "pos", "end_pos", F.explode("stated").alias("key")).hint(_MERGE)
    items = pairs.join(stated_, (pairs["page_id"] == stated_["page_id"]) & (pairs["item"] == stated_["key"]))
    fields = pairs.join(stated_, (pairs["page_id"] == stated_["page_id"]) & (pairs["field"] == stated_["key"]))
    pair = [pairs[c] for c in ("page_id", "item", "field")]
    both = items.select(*pair, "pos", "end_pos", F.lit(None).cast("int").alias("at")).unionByName(
        fields.select(*pair, "pos", F.lit(None).cast("int").alias("end_pos"), F.col("pos").alias("at"))
    )
    later = Window.partitionBy("page_id", "item", "field").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("next", F.min("at").over(later)).filter("end_pos IS NOT NULL AND next <= end_pos")
    return held.groupBy("page_id", "item", "field").agg(F.count("*").alias("hits"))


def page_list_rules(elements: DataFrame) -> DataFrame:
    """List rule of every listed element (X13): page_id, node_id, item_selector, field_selector, hits."""
    alike = Window.partitionBy("page_id", "parent_pos", "signature")
    listed = elements.filter("node_id > 0")
    twins = listed.withColumn("twins", F.count("*").over(alike)).filter((F.col("twins") >= MIN_SIBLINGS) & (F.col("parent_id") > 0)).select("page_id", "pos")
    rules = listed.select("page_id", "node_id", F.explode("rules").alias("r")).select("page_id", "node_id", "r.*").join(twins.hint(_MERGE), ["page_id", "pos"])
    pairs = rules.select("page_id", "item", "field").distinct()
    scored = rules.join(items_holding(elements, pairs).hint(_MERGE), ["page_id", "item", "field"])
    best = scored.groupBy("page_id", "node_id").agg(F.max_by(F.struct("item", "field", "hits"), F.struct("hits", -F.col("i"))).alias("b"))
    out = listed.select("page_id", "node_id", "itself").join(best.hint(_MERGE), ["page_id", "node_id"], "left")
    return out.select(
        "page_id", "node_id", F.coalesce("b.item", F.lit("")).alias("item_selector"),
        F.coalesce("b.field", "itself").alias("field_selector"), F.coalesce("b.hits", F.lit(1)).alias("hits"),
    )
