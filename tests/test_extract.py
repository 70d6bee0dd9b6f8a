import pytest
from pyspark.sql import functions as F

from webloom.functions.selectors import css_plan_lit, path_plan_lit, read_css, read_regex, read_xpath
from webloom.operators import extract, induction
from webloom.sources.tables import append_results

FIELDS = [
    {"name": "study", "kind": "css", "expr": "cite", "attr": "text"},
    {"name": "author", "kind": "css", "expr": ".who", "attr": "text"},
    {"name": "year", "kind": "regex", "expr": r"(19\d\d)", "attr": "text"},
]


def items_of(pages, item, fields, links=""):
    return extract.preview(pages, item, links, fields).filter("page_id = 1").select("items", "links").first()


def test_items_and_links(library):
    got = items_of(library, ".work", FIELDS, "a.entry")
    assert len(got["items"]) == 9 and len(got["links"]) == 9
    assert got["items"][2] == {"study": "Study 3", "author": "Author 3", "year": "1953"}
    assert got["links"][0] == "http://library.test/works/w-1.html"


def test_xpath_items(library):
    fields = [
        {"name": "study", "kind": "xpath", "expr": ".//cite", "attr": "text"},
        {"name": "href", "kind": "xpath", "expr": "./a/@href"},
        {"name": "by_class", "kind": "xpath", "expr": "//span[contains(concat(' ', normalize-space(@class), ' '), ' year ')]"},
        {"name": "second", "kind": "xpath", "expr": "span[2]"},
        {"name": "self", "kind": "xpath", "expr": "//li"},
        {"name": "odd", "kind": "xpath", "expr": "count(//a)"},
    ]
    items = items_of(library, ".work", fields)["items"]
    assert len(items) == 9
    first = items[0]
    assert (first["study"], first["href"], first["by_class"], first["second"]) == ("Study 1", "/works/w-1.html", "1951", "1951")
    assert first["self"] == "" and first["odd"] == "" and "unsupported" in first["odd_error"]


def test_values_by_attr(library):
    fields = [
        {"name": "item_class", "kind": "css", "expr": ".work", "attr": "class"},
        {"name": "id", "kind": "css", "expr": "li", "attr": "id"},
        {"name": "inner", "kind": "css", "expr": "q", "attr": "html"},
        {"name": "no_title", "kind": "css", "expr": "a", "attr": "title"},
        {"name": "fallback", "kind": "css", "expr": "a", "attr": "data-none"},
        {"name": "miss", "kind": "css", "expr": ".none"},
        {"name": "outside", "kind": "css", "expr": "ol cite"},
        {"name": "source", "kind": "regex", "expr": 'id="(w-[0-9]+)"', "attr": "html"},
        {"name": "bad", "kind": "regex", "expr": "(", "attr": "text"},
        {"name": "look", "kind": "regex", "expr": "(?=a)", "attr": "text"},
        {"name": "hover", "kind": "css", "expr": "a:hover"},
        {"name": " ", "kind": "css", "expr": "x"},
        {"name": "kind", "kind": "json", "expr": "x"},
    ]
    item = items_of(library, ".work", fields)["items"][1]
    assert item["item_class"] == "work" and item["id"] == "w-2" and item["source"] == "w-2"
    assert item["inner"] == "Notes on 2" and item["no_title"] == "" and item["fallback"] == "record"
    assert item["miss"] == "" and item["outside"] == "" and item["bad"] == "" and item["hover"] == ""
    assert "bad_error" in item and "look_error" in item and "hover_error" in item and "kind" not in item


def test_whole_page_scope_and_no_fields(library):
    assert items_of(library, "", [{"name": "h", "kind": "css", "expr": "div > h1"}])["items"] == [{"h": "Reading list"}]
    assert items_of(library, ".work", [])["items"] == []
    broken = extract.preview(library, "a[[", "a:hover", FIELDS).first()
    assert broken["items"] == [] and broken["links"] == [] and broken["rule_error"].count("unsupported") == 2
    assert extract.preview(library, ".work", "", FIELDS).first()["rule_error"] == ""


def matches(doms, selector):
    return induction.count_css(doms, css_plan_lit(selector)).filter("page_id = 1").first().hits


@pytest.fixture(scope="module")
def doms(library):
    return extract.with_dom(library.filter("page_id = 1")).cache()


@pytest.mark.parametrize(
    ("selector", "hits"),
    [
        ("*", 65), ("cite", 9), ("LI.work", 9), ("#w-3", 1), ("[id]", 9), ("[href^='/works']", 9),
        ("[href$='.html']", 9), ("[class~=who]", 9), ("[id='w-1'], [id=\"w-2\"]", 2), ("div a", 10), ("div > a", 0),
        ("div > ol > li > a", 9), ("span + q", 9), ("cite ~ span", 18), ("li:first-child", 1),
        ("li:nth-child(2n+1)", 5), ("li:nth-child(-n+3)", 3), ("li:last-child cite", 1),
        ("li span:nth-of-type(2)", 9), ("p a:not-supported", None), ("p a:only-of-type", 1),
        ("li:nth-child(3) .year, h1", 2),
        ("a:not(.entry)", 1), ("li:not(#w-2):not([id='w-3'])", 7), ("span:not(.who, .year)", 0), ("li > :not(span)", 27),
        ("meta:empty", 1), ("li:empty", 0), ("a:not()", None),
        ("li > :not(span.who)", 36), ("li:has(cite)", 9), ("li:has(> cite)", 9), ("ol:has(> cite)", 0), ("li:has(> a)", 9), ("ol:has(span.year, b)", 1),
        ("li:has(h1)", 0), ("cite:contains('Study 3')", 1), ("li:contains(Study)", 9), ("li:containsOwn(Study)", 0),
        ("li:has(cite:contains('Study 3')) > span", 2), ("li:not(:contains('Study 3'))", 8), ("li:has(a:has(b))", None),
    ],
)
def test_css_subset(doms, selector, hits):
    if hits is None:
        with pytest.raises(ValueError):
            read_css(selector)
    else:
        assert matches(doms, selector) == hits


def test_readers_reject_what_they_do_not_cover():
    for bad in ("", "a >", "> a", "a,,b", "a b[", "div:hover"):
        with pytest.raises(ValueError):
            read_css(bad)
    for bad in ("", "(//a | //b)[1]", "(//a/text())[1]", "((//a)[1])[1]", "(//a", "//li/ancestor::ol[last()]", "//a/text()/..",
                "//li[@x][1][@y]", "//li/following-sibling::li[@x][1]", "//descendant::li[1]", "//following-sibling::li", "//li[last() + 1]", "a|@b", "//a[@x", "//a|", "//a[not(not(@x))]"):
        with pytest.raises(ValueError):
            read_xpath(bad)
    assert read_regex(r"(?P<a>x)(y)") == (r"(?d)(?<a>x)(y)", 1)


def test_rules_as_data(spark, library):
    fields = "array<struct<name:string,kind:string,expr:string,attr:string>>"
    rules = spark.createDataFrame(
        [
            (1, 7, ".work", "a.entry", [("t", "css", "cite", ""), ("t", "css", ".year", "")]),
            (1, 8, "", "", [("h", "xpath", "//h1", "text")]),
            (2, 9, "dl", "", []),
        ],
        f"kind int, id bigint, item_selector string, link_selector string, fields {fields}",
    )
    pages = library.withColumn("kind", F.when(F.col("page_id") == 1, 1).otherwise(2))
    out = extract.extract_by_rules(pages, rules, ["kind"]).cache()
    by_rule = {(r.page_id, r.rule_id): r["items"] for r in out.collect()}
    assert len(by_rule) == 11
    assert len(by_rule[1, 7]) == 9 and by_rule[1, 7][0] == {"t": "1951"}
    assert by_rule[1, 8] == [{"h": "Reading list"}] and by_rule[5, 9] == []
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    try:
        spark.conf.set(threshold, "-1")
        again = extract.extract_by_rules(pages, rules, ["kind"])
        assert {(r.page_id, r.rule_id): r["items"] for r in again.collect()} == by_rule
    finally:
        spark.conf.set(threshold, before)


def test_results_are_appended_per_task(spark, library, tmp_path):
    rows = extract.result_rows(extract.preview(library, ".work", "", FIELDS), F.lit(5))
    append_results(rows, str(tmp_path / "results"))
    append_results(rows, str(tmp_path / "results"))
    back = spark.read.parquet(str(tmp_path / "results")).filter("task_id = 5")
    assert back.count() == 18
    assert back.first().payload["_url"] == "http://library.test/works/index.html"


def test_body_cap(spark):
    big = spark.range(1).select(F.concat(F.repeat(F.lit("a"), extract.BODY_CAP - 1), F.lit("éb")).alias("h"))
    assert big.select(F.length(extract.cap_body(F.col("h")))).first()[0] == extract.BODY_CAP


@pytest.mark.parametrize(
    ("path", "hits"),
    [
        ("//cite | //h1", 10), ("//cite[text()='Study 3']", 1), ("//li[contains(., 'Study 3')]", 1),
        ("//span[not(@class='who')]", 9), ("//li[starts-with(text(), 'Study')]", 0), ("//a[not(contains(@href, '/works'))]", 1),
    ],
)
def test_xpath_unions_and_tests(doms, path, hits):
    found = extract.select_nodes(F.col("dom.nodes"), path_plan_lit(path), F.lit(0), F.lit(0), F.col("dom.text"))
    assert doms.select(F.size(found).alias("hits")).first().hits == hits


@pytest.mark.parametrize(
    ("path", "hits"),
    [
        ("//cite/..", 9), ("//a/..", 10), ("//span/parent::li", 9), ("//span/parent::ol", 0), ("//a/../..", 2),
        ("//li[@id='w-3']/following-sibling::li", 6), ("//li[@id='w-3']/following-sibling::li[2]", 1),
        ("//li[@id='w-3']/preceding-sibling::li", 2), ("//li[@id='w-1']/preceding-sibling::*", 0),
        ("//cite/following-sibling::span[position() <= 1]", 9), ("//cite/following-sibling::*[4]/..", 9), ("//q/preceding-sibling::span[1]", 9),
        ("//li[@id='w-3' or @id='w-5']/following-sibling::li[1]", 2), ("//li[@id='w-2']/following-sibling::li/preceding-sibling::li[1]", 7),
        ("//q/ancestor::*[1]", 9), ("//q/ancestor::div", 1), ("//q/ancestor::*", 13), ("//q/ancestor::*[2]", 1), ("//q/ancestor::ol[1]", 1),
        ("//li[position() > 2]", 7), ("//li[position() mod 2 = 1]", 5), ("//li[last() - 1]", 1), ("//li[position() < last()]", 8),
        ("//li[position() = last()]", 1), ("//li[position() > 2 and position() <= 4]", 2), ("//li[position() mod 3 = 0]", 3),
        ("//ol[count(li) >= 9]", 1), ("//ol[count(li) > 9]", 0), ("//li[count(span) = 2]", 9), ("//div[count(.//span) = 18]", 1),
        ("//li[count(*) != 5]", 0), ("//li[count(*) != 4]", 9), ("//li[count(b) < 1]", 9), ("//li[not(count(a) = 1)]", 0),
        ("(//a)[1]", 1), ("(//a)[last()]", 1), ("(//li)[3]/span", 2), ("(//li)[20]", 0), ("(//cite | //q)/..", 9),
        ("//li[span[@class='year' and text()='1953']]", 1), ("//ol[.//q]", 1), ("//ol[q]", 0), ("//li[a][@id='w-4']", 1), ("//li[a][2]", 1), ("//span[not(@class='who')][1]", 9), ("//li[span[2]][last()]", 1),
        ("//span[@class='year'][1]", 9), ("//span[@class='year'][2]", 0), ("//li[contains(., 'Study')][last()]", 1), ("//li[position() > 3][1]", 1),
        ("//li/self::li", 9), ("//li/child::span", 18), ("//ol/descendant::span", 18), ("//li[@id='w-1' or @id='w-2' and @class='none']", 1),
        ("//a[contains(text(), 'this or that') or text()='Home']", 1),
    ],
)
def test_xpath_axes_positions_and_counts(doms, path, hits):
    found = extract.select_nodes(F.col("dom.nodes"), path_plan_lit(path), F.lit(0), F.lit(0), F.col("dom.text"))
    assert doms.select(F.size(found).alias("hits")).first().hits == hits


def test_xpath_values_inside_items(library):
    """Fields of an item: axes stay inside it; values of the n-th of all, of a union in parentheses, beside an element."""
    fields = [
        {"name": "first", "kind": "xpath", "expr": "(.//span)[1]", "attr": "text"},
        {"name": "last", "kind": "xpath", "expr": "(.//span)[last()]/text()"},
        {"name": "href", "kind": "xpath", "expr": "(.//*/@href)[1]"},
        {"name": "beside", "kind": "xpath", "expr": ".//cite/following-sibling::span[2]/text()"},
        {"name": "before", "kind": "xpath", "expr": ".//q/preceding-sibling::span[1]/text()"},
        {"name": "either", "kind": "xpath", "expr": "(.//q | .//cite)/text()"},
        {"name": "outside", "kind": "xpath", "expr": ".//q/ancestor::ol", "attr": "id"},
    ]
    item = items_of(library, ".work", fields)["items"][3]
    assert (item["first"], item["last"], item["href"], item["beside"]) == ("Author 4", "1954", "/works/w-4.html", "1954")
    assert (item["before"], item["either"], item["outside"]) == ("1954", "Study 4", "")
