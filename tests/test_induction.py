import pytest
from pyspark.sql import functions as F

from webloom.functions.selectors import css_plan_lit
from webloom.operators import boxes, extract, induction


@pytest.fixture(scope="module")
def doms(library):
    return extract.with_dom(library).cache()


@pytest.fixture(scope="module")
def nodes(doms):
    return extract.dom_nodes(doms).filter("page_id = 1").cache()


def click(spark, doms, nodes, where):
    node_id = nodes.filter(where).orderBy("node_id").first().node_id
    clicks = spark.createDataFrame([(1, node_id)], "page_id bigint, node_id int")
    return induction.infer(doms, clicks).first()


def test_click_on_an_author_generalises_to_all_works(spark, doms, nodes):
    got = click(spark, doms, nodes, "array_contains(classes, 'who')")
    assert tuple(got.list_rule) == (".work", ".who", 9)
    exprs = {(c.kind, c.expr): c for c in got.candidates}
    by_class = exprs["css", "span.who"]
    assert by_class.hits == 9 and not by_class.unique
    below = exprs["css", "#w-1 .who"]
    assert below.unique and below.score > by_class.score and abs(below.score - 1.0) < 1e-9


def test_click_without_class_is_named_by_tag(spark, doms, nodes):
    got = click(spark, doms, nodes, "tag = 'cite'")
    assert tuple(got.list_rule) == (".work", "cite", 9)
    assert ("xpath", "//*[@id='w-1']//cite", 1) in {(c.kind, c.expr, c.hits) for c in got.candidates}


def test_id_is_preferred(spark, doms, nodes):
    got = click(spark, doms, nodes, "id_attr = 'w-1'")
    assert got.candidates[0].expr.startswith("#w-1") and got.candidates[0].unique
    assert got.candidates[1].expr == "//*[@id='w-1']" and got.candidates[1].unique
    # The work does not contain itself, so there is nothing to repeat.
    assert tuple(got.list_rule) == ("", ".work", 1)


def test_paths(spark, doms, nodes):
    got = click(spark, doms, nodes, "tag = 'h1'")
    exprs = [c.expr for c in got.candidates]
    assert "body:nth-child(2) > div.sheet > h1:nth-child(1)" in exprs
    assert "//body[1]/div[1]/h1[1]" in exprs
    assert tuple(got.list_rule) == ("", "h1", 1)


def test_data_attributes_and_combos(spark):
    html = """<body><form><input name="q" type="text" data-role="box" class="w"><input name="q" type="text">
              <input name="r" type="text"></form></body>"""
    pages = spark.createDataFrame([(1, "http://x/", html)], "page_id bigint, url string, html string")
    doms = extract.with_dom(pages)
    found = click(spark, doms, extract.dom_nodes(doms), "tag = 'input'")
    hits = {c.expr: c.hits for c in found.candidates}
    assert hits["[data-role='box']"] == 1 and hits["//*[@data-role='box']"] == 1
    assert hits["input.w"] == 1 and hits["input.w[name='q'][type='text']"] == 1
    assert found.candidates[0].expr == "[data-role='box']"


def test_absolute_xpath(doms):
    ns = F.col("dom.nodes")
    paths = doms.filter("page_id = 1").select(
        F.explode(F.transform(ns, lambda n: induction.absolute_xpath(ns, n))).alias("x")
    )
    got = {r.x for r in paths.collect()}
    assert "/body/div/h1" in got and "//*[@id='w-2']" in got and "/*[@id='w-2']/span[2]" in got
    assert "/body/div/p/a" in got


def test_sibling_clusters(doms):
    got = induction.sibling_clusters(doms).collect()
    assert [(r.signature, r.siblings) for r in got] == [("li|work|cite,span.who,span.year,q,a.entry", 9)]


def test_hit_counts(doms, nodes):
    hits = {r.expr: (r.hits, r.unique) for r in induction.selector_hits(nodes).collect()}
    assert hits["li.work"] == (9, False) and hits["#w-7"] == (1, True)
    assert induction.list_hits(doms, css_plan_lit(".work"), css_plan_lit(".year")).filter("page_id = 1").first().hits == 9


def test_visible_nodes(nodes):
    tags = {r.tag for r in boxes.visible_nodes(nodes).collect()}
    assert "cite" in tags and "li" in tags and not tags & {"html", "head", "meta", "title", "body"}
    boxed = nodes.withColumn("box", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
                             F.when(F.col("tag") == "cite", 5.0).otherwise(0.0).alias("w"), F.lit(5.0).alias("h")))
    assert {r.tag for r in boxes.visible_nodes(boxed).collect()} == {"cite"}


def test_hit_test(spark):
    shapes = spark.createDataFrame(
        [(1, 1, 0.0, 0.0, 1440.0, 900.0), (1, 2, 100.0, 100.0, 50.0, 50.0), (1, 3, 100.0, 100.0, 50.0, 50.0),
         (1, 4, 100.0, 100.0, 0.0, 9.0), (2, 5, 0.0, 0.0, 500.0, 500.0)],
        "page_id int, node_id int, x double, y double, w double, h double",
    )
    points = spark.createDataFrame(
        [(1, 1, 150.0, 150.0), (1, 2, 151.0, 150.0), (1, 3, 1441.0, 1.0), (2, 4, 128.0, 64.0)],
        "page_id int, point_id int, x double, y double",
    )
    got = {r.point_id: r.node_id for r in boxes.hit_test(points, shapes).collect()}
    assert got == {1: 2, 2: 1, 4: 5}


def test_boxes_behind_a_covering_one_leave_the_cell(spark):
    rows = [(1, n, 0.0, 0.0, 64.0 + n, 64.0 + n) for n in range(100)] + [(1, 200, 10.0, 10.0, 5.0, 5.0), (1, 201, 70.0, 70.0, 9.0, 9.0)]
    shapes = spark.createDataFrame(rows, "page_id int, node_id int, x double, y double, w double, h double")
    first = boxes.cell_boxes(shapes).filter("_cx = 0 AND _cy = 0")
    assert sorted(r.node_id for r in first.collect()) == [0, 200]
    points = spark.createDataFrame([(1, 1, 11.0, 11.0), (1, 2, 20.0, 63.0), (1, 3, 64.5, 1.0), (1, 4, 72.0, 72.0), (1, 5, 300.0, 1.0)], "page_id int, point_id int, x double, y double")
    hits = boxes.hit_test(points, shapes)
    assert {r.point_id: r.node_id for r in hits.collect()} == {1: 200, 2: 0, 3: 1, 4: 201}
    assert "BroadcastHashJoin" not in hits._jdf.queryExecution().executedPlan().toString()
