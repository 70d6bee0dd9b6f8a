"""Inference over all elements of a page against the per-click functions, which run the matcher for every candidate."""

import pytest
from pyspark.sql import functions as F

from webloom.operators import extract, induction, inference

DEEP = "<div>" * 11 + '<i name="x" type="y">deep</i>' + "</div>" * 11
PAGES = [
    (1, """<body><div id="top" class="bar wide"><h1 itemprop="name" data-k="a">T</h1></div><ul class="cards">"""
     + "".join(f'<li class="card{" odd" if i % 2 else ""}" data-no="{i}"><h2 class="name">n</h2><a class="more" name="go" type="t{i % 2}">x</a></li>' for i in range(5))
     + f"""</ul><div class="bar"><p id="dup">a</p><p id="dup">b<span>c</span></p>{DEEP}</div></body>"""),
    (2, '<body><p id="9bad" class="1x ok">a</p><div id="out"><div id="in"><b id="z1" class="z y" data-a="1" data-b="2" data-c="3" name="n" type="t">1</b><b class="z">2</b><b class="z">3</b></div></div></body>'),
    (3, '<table><tr><td>a<td>b<td>c<tr><td>d<td class="last" role="cell" name="q r">e</table><input name="a" type="b" role="c" itemprop="d">'),
    (4, ""), (5, None), (6, "just text"), (7, "<body>" + "<div><em>a</em></div>" * 3 + "<div><u>a</u></div>" + DEEP + "</body>"),
]


@pytest.fixture(scope="module")
def both(spark, library):
    pages = spark.createDataFrame(PAGES, "page_id long, html string").withColumn("url", F.lit("http://h.test/"))
    pages = pages.unionByName(library.select((F.col("page_id") + 100).alias("page_id"), "html", "url"))
    clicks = extract.dom_nodes(extract.with_dom(pages)).select("page_id", "node_id")
    return pages, clicks, inference.page_elements(pages)


def test_candidates_of_all_elements(both):
    pages, clicks, elements = both
    want = {(r["page_id"], r["node_id"]): [tuple(c) for c in r["candidates"]] for r in induction.infer_candidates(pages, clicks).collect()}
    got = {}
    for r in sorted(inference.page_candidates(elements).collect(), key=lambda r: (r["page_id"], r["node_id"], r["rank"])):
        got.setdefault((r["page_id"], r["node_id"]), []).append((r["kind"], r["expr"], r["unique"], r["score"], r["hits"]))
    assert got == want
    assert any(len(v) == 8 for v in want.values()) and any(c[4] > 1 and c[1].startswith("//") for v in want.values() for c in v)
    texts = {c[1] for v in want.values() for c in v}
    assert any(t.count("/") > 8 for t in texts)  # a path cut at its eighth step


def test_list_rules_of_all_elements(both):
    pages, clicks, elements = both
    want = {(r["page_id"], r["node_id"]): tuple(r["list_rule"]) for r in induction.infer_list_rules(pages, clicks).collect()}
    got = {(r["page_id"], r["node_id"]): (r["item_selector"], r["field_selector"], r["hits"]) for r in inference.page_list_rules(elements).collect()}
    assert got == want
    assert any(v[2] > 2 for v in want.values())


def test_no_side_of_a_join_goes_through_the_driver(both):
    elements = both[2]
    for out in (inference.page_list_rules(elements), inference.page_candidates(elements)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
