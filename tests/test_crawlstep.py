from pyspark.sql import functions as F

from webloom.operators.crawlstep import crawl_step
from webloom.operators.telemetry import stats_map

RULE = "array<struct<name:string,kind:string,expr:string,attr:string>>"


def test_one_step_over_the_library(spark, library):
    url = "http://library.test/works/index.html"
    jobs = spark.createDataFrame(
        [(1, 1, url, 0), (1, 1, "http://library.test/works/w-1.html", 1), (1, 1, "http://library.test/gone", 1),
         (1, 1, "http://library.test/works/w-2.html", 1), (1, 9, "http://library.test/works/w-3.html", 1),
         (2, 1, url, 0), (3, 2, url, 2)],
        "task_id bigint, rule_id bigint, url string, depth int",
    )
    tasks = spark.createDataFrame(
        [(1, "running", 1), (2, "paused", 5), (3, "running", 2)], "task_id bigint, status string, max_depth int"
    )
    rules = spark.createDataFrame(
        [(1, ".work", "a.entry", [("study", "css", "cite", "")], True), (2, "", "a", [("h", "css", "h1", "")], False)],
        f"rule_id bigint, item_selector string, link_selector string, fields {RULE}, respect_robots boolean",
    )
    robots = spark.createDataFrame([("library.test", "User-agent: *\nDisallow: /works/w-2")], "host string, body string")
    gone = F.col("url").endswith("w-1.html")
    pages = library.withColumn("status", F.when(gone, 404).otherwise(200))
    step = crawl_step(jobs, tasks, rules, pages, robots)
    seen = spark.createDataFrame([(1, "http://library.test/works/w-1.html")], "task_id bigint, url string")
    got = {r.task_id: r.asDict() for r in step.counters(seen).collect()}
    assert set(got) == {1, 3}
    # Task 1: the list gives 9 results and 9 links of which one is known; one 404, one URL
    # without reply, one job without rule, one URL closed by robots.
    assert got[1] == {"task_id": 1, "crawled": 2, "failed": 3, "results": 9, "robots_skip": 1, "enqueued": 8, "duplicated": 1}
    assert got[3] == {"task_id": 3, "crawled": 1, "failed": 0, "results": 1, "robots_skip": 0, "enqueued": 0, "duplicated": 0}
    assert step.results.count() == 10
    assert {r.payload["_url"] for r in step.results.collect()} == {url}
    offers = step.offers.collect()
    assert len(offers) == 9 and {(r.depth, r.priority) for r in offers} == {(1, 5)}
    stats = {r.task_id: r.stats for r in stats_map(step.counters(seen)).collect()}
    assert stats[3] == {"crawled": 1, "results": 1}


def test_jobs_of_one_url_meet_their_own_fetches(spark):
    url = "http://library.test/news"
    jobs = spark.createDataFrame([(1, 1, 1, url, 0), (2, 1, 1, url, 0), (3, 2, 1, url, 0)], "page_id bigint, task_id bigint, rule_id bigint, url string, depth int")
    tasks = spark.createDataFrame([(1, "running", 1), (2, "running", 1)], "task_id bigint, status string, max_depth int")
    rules = spark.createDataFrame(
        [(1, "", "a", [("h", "css", "h1", "")], False)],
        f"rule_id bigint, item_selector string, link_selector string, fields {RULE}, respect_robots boolean",
    )
    robots = spark.createDataFrame([("library.test", "")], "host string, body string")
    pages = spark.createDataFrame(
        [(1, url, "<h1>one</h1><a href=/a>a</a>", 200), (2, url, "<h1>two</h1><a href=/b>b</a>", 200), (3, url, "", 503)],
        "page_id bigint, url string, html string, status int",
    )
    step = crawl_step(jobs, tasks, rules, pages, robots, fetch=("page_id", "url"))
    seen = spark.createDataFrame([], "task_id bigint, url string")
    got = {r.task_id: (r.crawled, r.failed, r.results, r.enqueued, r.duplicated) for r in step.counters(seen).collect()}
    assert got == {1: (2, 0, 2, 2, 0), 2: (1, 1, 0, 0, 0)}
    assert sorted(r.payload["h"] for r in step.results.collect()) == ["one", "two"]
