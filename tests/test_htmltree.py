import re

import pyarrow as pa
import pytest

from webloom.operators import boxes, extract, induction
from webloom.sources.htmltree import MAX_DEPTH, PARSERS, RUN_BYTES, page_runs, shred_batch


def shape(html: str) -> str:
    return shred_batch([html], True).to_pylist()[0]["html"]


def body(html: str) -> str:
    return shape(html).removeprefix("<html><head></head><body>").removesuffix("</body></html>")


def test_implied_elements_and_end_tags():
    assert body("<p>a<p>b") == "<p>a</p><p>b</p>"
    assert body("<ul><li>1<li>2</ul>x") == "<ul><li>1</li><li>2</li></ul>x"
    assert body("<table><tr><td>1<td>2<tr><td>3</table>") == (
        "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"
    )
    assert body("<select><option>a<option>b</select>") == "<select><option>a</option><option>b</option></select>"
    assert body("a</p>b") == "a<p></p>b"
    assert body("<div><p>x</div>y") == "<div><p>x</p></div>y"
    assert body("<h1>a<h2>b</h2>") == "<h1>a</h1><h2>b</h2>"
    assert body("</div><span>x</i></span>") == "<span>x</span>"


def test_formatting_elements_reopen():
    assert body("<p><b>x<p>y") == "<p><b>x</b></p><p><b>y</b></p>"
    assert body("<p>1<b>2</p>3</b>4") == "<p>1<b>2</b></p><b>3</b>4"


def test_raw_text_and_entities():
    assert body("x<script>if (a<b) '</p>'</script>&lt;&amp&eacute;") == "x<script>if (a<b) '</p>'</script>&lt;&amp;é"
    assert body('<a href="/x?a=1&copy=2&amp;b=3">y</a>') == '<a href="/x?a=1&amp;copy=2&amp;b=3">y</a>'
    assert shape("<title>a &amp; <b></title><p>x") == (
        "<html><head><title>a &amp; &lt;b&gt;</title></head><body><p>x</p></body></html>"
    )
    assert body("a <!-- <p>no</p> --> b") == "a <!-- <p>no</p> --> b"
    assert body("1 < 2") == "1 &lt; 2"


def test_ids_skip_unlisted_subtrees():
    page = shred_batch(["<div><script>x</script><svg><path/></svg><p id=A class='x x y'>t</p></div>"], False).to_pylist()[0]
    p = next(n for n in page["nodes"] if n["tag"] == "p")
    assert (p["node_id"], p["sib_idx"], p["el_idx"], p["id_attr"], p["classes"]) == (5, 0, 3, "A", ["x", "y"])
    assert all(n["node_id"] == 0 for n in page["nodes"] if n["tag"] in ("script", "svg", "path"))
    assert page["text"] == "xt"


def test_depth_is_bounded():
    page = shred_batch(["<div>" * 2000], False).to_pylist()[0]
    assert len(page["nodes"]) == 2003
    assert max(n["depth"] for n in page["nodes"]) < MAX_DEPTH


def test_empty_and_missing_pages():
    for page in shred_batch(["", None, "   "], True).to_pylist():
        assert [n["tag"] for n in page["nodes"]] == ["html", "head", "body"]


def test_batches_are_taken_apart_in_runs():
    pages = ["<p>%d" % i for i in range(50)] + ["x" * (RUN_BYTES + 1), None, "", "<p>last"]
    runs = [r.to_pylist() for r in page_runs(pa.array(pages))]
    assert sum(runs, []) == pages and [len(r) for r in runs] == [50, 1, 3]
    assert list(page_runs(pa.array([], pa.string()))) == []
    # The parser itself yields a run at a time: it has not read the second batch when the first run is out.
    read = iter([pa.array(pages), None])
    assert len(next(PARSERS[False].func(read))) == 50 and next(read) is None


def test_runs_keep_rows_together(spark):
    pages = spark.range(0, 3000, 1, 1).selectExpr("id AS page_id", "concat('<p id=n', id, '>', repeat('y', 400)) AS html")
    doms = pages.withColumn("dom", PARSERS[True]("html"))
    assert doms.filter("dom.nodes[3].id_attr = concat('n', page_id) AND length(dom.text) = 400 AND length(html) > 400").count() == 3000


def test_node_table(spark, library):
    nodes = extract.dom_nodes(extract.with_dom(library)).filter("page_id = 1").cache()
    assert nodes.filter("tag = 'li'").count() == 9
    root = nodes.filter("node_id = 1").first()
    assert root.tag == "html" and root.end_id == nodes.count() and len(root.text) == 80
    work = nodes.filter("id_attr = 'w-3'").first()
    assert work.end_id - work.node_id == 5 and work.attrs["class"] == "work"
    places = induction.sibling_positions(nodes)
    assert places.join(nodes, ["page_id", "node_id", "sib_idx", "type_idx"]).count() == nodes.count()


@pytest.mark.parametrize("visible", [False, True])
def test_exploded_nodes_do_not_carry_their_page(spark, visible):
    """The rows of a page are buffered together: with the page in each, memory grew with the square of its length."""
    html = "<body><p> a \t b </p>" + "<div>" + " " * 1200 + "late</div>" + "<i>x</i>" * 50
    nodes = extract.dom_nodes(extract.with_dom(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")))
    found = (boxes.visible_nodes(nodes) if visible else nodes).select("page_id", "tag", "text")
    exploded = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate " in x]
    assert len(exploded) == 1
    assert not re.search(r"\[page_id#\d+L, ", exploded[0])
    rows = found.filter("page_id = 1").collect()
    assert {r.text for r in rows if r.tag in ("p", "div", "i")} == {"a b", "late", "x"}
    assert found.filter("page_id = 2").count() == (0 if visible else 3)
