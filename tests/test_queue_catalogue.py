import os
import time

import pytest
from pyspark.sql import functions as F

from webloom.operators import catalogue as cat
from webloom.operators import queue, robots
from webloom.operators.frontier import expand_frontier, link_graph
from webloom.operators.extract import links_of, with_dom
from webloom.session import ensure_checkpoint_dir

JOBS = "id string, task_id bigint, priority int, enqueued_at bigint, attempt int, lease_expiry bigint"


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [
        ("a", 3, 1, 100, 0, None), ("b", 3, 9, 200, 0, None), ("c", 4, 9, 150, 1, None), ("d", 4, 9, 150, 0, None),
        ("e", 5, 5, 50, 0, 900), ("f", 5, 5, 50, 0, 2000),
    ]
    return spark.createDataFrame(rows, JOBS)


def test_order_and_take(jobs):
    ready = jobs.filter("lease_expiry IS NULL")
    assert [r.id for r in queue.in_job_order(ready).collect()] == ["c", "d", "b", "a"]
    even = ready.withColumn("priority", F.lit(0))  # without a priority the attempt decides
    assert [r.id for r in queue.in_job_order(even).collect()] == ["a", "d", "c", "b"]
    taken = queue.take_next(ready, 2, "w", 1000, ttl_s=5).collect()
    assert {(r.id, r.lease_expiry, r.owner) for r in taken} == {("c", 1005, "w"), ("d", 1005, "w")}
    assert queue.take_next(ready, 1, "w", 1000, ttl_s=99).first().lease_expiry == 1030
    assert queue.take_next(ready.limit(0), 3, "w", 1).count() == 0


def test_reclaim_ack_drop(spark, jobs):
    back = {r.id: r for r in queue.reclaim(jobs, F.lit(1000)).collect()}
    assert set(back) == {"a", "b", "c", "d", "e"}
    assert back["e"].reclaimed and back["e"].priority == 0 and back["e"].enqueued_at == 1000
    assert back["e"].lease_expiry is None and not back["a"].reclaimed
    kept = {r.id: r.priority for r in queue.reclaim(jobs, F.lit(1000), keep_priority=True).collect()}
    assert kept["e"] == 5
    acked = spark.createDataFrame([("a",), ("x",)], "id string")
    assert queue.acknowledge(jobs, acked).count() == 5
    three = spark.createDataFrame([(3,), (3,)], "task_id bigint")
    sub = jobs.filter("task_id IN (3, 4) AND id <> 'd'")
    assert [r.id for r in queue.drop_tasks(sub, three).collect()] == ["c"]
    assert [tuple(r) for r in queue.dropped_counts(sub, three).collect()] == [(3, 2)]


def test_status_moves():
    assert cat.sources_for("running") == ["created", "paused"]
    assert ("succeeded", "running") not in cat.TRANSITIONS and ("cancelled", "running") not in cat.TRANSITIONS


def test_transitions(spark):
    rows = [("created", "running"), ("paused", "running"), ("running", "paused"), ("succeeded", "running"),
            ("cancelled", "running"), (None, "failed"), ("failed", "failed")]
    df = spark.createDataFrame(rows, "prev_status string, status string")
    bad = {tuple(r) for r in cat.transition_violations(df).collect()}
    assert bad == {("succeeded", "running"), ("cancelled", "running")}


def test_patches_keep_blank_and_null(spark):
    fields = "array<struct<name:string,kind:string,expr:string,attr:string>>"
    schema = (
        f"id bigint, name string, start_url string, item_selector string, link_selector string, fields {fields}, "
        "respect_robots boolean, qps double"
    )
    rules = spark.createDataFrame(
        [(1, "n", "u", ".i", ".l", [("a", "css", "b", "text")], True, 2.0), (2, "m", "v", "", "", [], True, 1.0)], schema
    ).withColumn("version", F.lit(1))
    patches = spark.createDataFrame(
        [(1, "  ", "", ".j", "", None, None, 3.0, 1), (1, " new ", "", " ", "", [(" x ", "CSS", "y", "")], False, None, 2)],
        schema + ", seq int",
    )
    got = {r.id: r for r in cat.apply_patches(rules, patches).collect()}
    one = got[1]
    assert (one.name, one.start_url, one.item_selector, one.link_selector) == ("new", "u", "", ".l")
    assert [tuple(f) for f in one.fields] == [("x", "css", "y", "text")]
    assert (one.respect_robots, one.qps, one.version) == (False, 3.0, 3)
    assert got[2].version == 1 and got[2].name == "m"


def test_paging(spark):
    df = spark.range(1, 451).withColumnRenamed("id", "id")
    assert [r.id for r in cat.page_of(df, 0, 0).collect()] == list(range(450, 430, -1))
    assert cat.page_of(df, 3, 999).count() == 50
    assert [r.id for r in cat.page_after(df, 3, 5).collect()] == [2, 1]


def test_robots(spark):
    body = (
        "User-agent: other\nDisallow: /\nUser-Agent: *\nAllow: /\nDisallow: /secret # no\nDisallow:\nCrawl-delay: 1.5\n"
        "Disallow: /tie\nAllow: /tie\r\nuser-agent: WebLoom\nDisallow: /mine\nCrawl-delay: soon"
    )
    hosts = spark.createDataFrame([("A.test", body), ("b.test", "")], "host string, body string")
    urls = spark.createDataFrame(
        [(u,) for u in ("http://a.test/ok", "http://a.test/secret/x", "http://A.test:80/tie", "http://a.test/mine",
                        "http://b.test/secret", "http://c.test/", "http://a.test")],
        "url string",
    )
    got = {r.url: (r.allowed, r.delay) for r in robots.check_robots(urls, hosts).collect()}
    assert got["http://a.test/ok"] == (True, 1.5) and got["http://a.test/secret/x"] == (False, 1.5)
    assert got["http://A.test:80/tie"][0] is False and got["http://a.test/mine"][0] is False
    assert got["http://b.test/secret"] == (True, 0.0) and got["http://c.test/"] == (True, 0.0)
    assert got["http://a.test"][0] is True
    assert robots.policy_rows(hosts).count() == 6


def test_frontier_on_the_library(spark, library):
    links = links_of(with_dom(library), "a.entry").cache()
    edges = links.select(F.col("url").alias("src"), F.col("link").alias("dst"))
    assert edges.count() == 18
    seeds = spark.createDataFrame([(1, "http://library.test/works/index.html")] * 2, "task_id int, url string")
    reached = expand_frontier(seeds, edges, 2).groupBy("depth").count().collect()
    assert {r.depth: r["count"] for r in reached} == {0: 1, 1: 9}
    assert expand_frontier(seeds, edges, 0).count() == 10
    graph = link_graph(links.select("page_id", "link"), library)
    assert graph.filter("to_page IS NULL").count() == 0 and graph.count() == 18


def test_frontier_stops_at_depth_and_follows_cycles_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "c")], "src string, dst string")
    seeds = spark.createDataFrame([(1, "a"), (2, "c")], "task_id int, url string")
    got = {(r.task_id, r.url): r.depth for r in expand_frontier(seeds, edges, 1).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 1, (2, "c"): 0, (2, "a"): 1, (2, "d"): 1}


def test_frontier_rounds_are_written_once(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    seeds = spark.createDataFrame([(1, "a"), (2, "b")], "task_id bigint, url string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    before = set(os.listdir(folder))
    got = sorted(map(tuple, expand_frontier(seeds, edges).collect()))
    assert got == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (1, "d", 3), (2, "a", 2), (2, "b", 0), (2, "c", 1), (2, "d", 2)]
    assert len(set(os.listdir(folder)) - before) == 1  # the table of what was seen, nothing beside it


def test_frontier_slices_give_the_same_rows_and_leave_no_shuffle_files(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffle_files() -> set[str]:
        return {f for top in local for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}

    urls = [(f"u{i}", f"u{(i * m + 1) % 60}") for i in range(40) for m in (2, 3, 5)]  # 40 to 59 lead nowhere
    edges = spark.createDataFrame([*urls, *urls[:9], ("u3", None)], "src string, dst string")
    starts = [(t, f"u{t * 7 % 40}") for t in range(25)]
    seeds = spark.createDataFrame([*starts, *starts[:3], (99, "nowhere"), (98, None)], "task_id int, url string")
    want = {(t, u): 0 for t, u in starts} | {(99, "nowhere"): 0, (98, None): 0}
    new, depth = list(want), 0
    links = {u: {d for s, d in [*urls, ("u3", None)] if s == u} for u in {s for s, _ in urls}}
    while new:
        depth += 1
        new = sorted({(t, d) for t, u in new for d in links.get(u, ())} - set(want), key=str)
        want |= dict.fromkeys(new, depth)
    before = shuffle_files()
    reached = expand_frontier(seeds, edges, slice_rows=1)
    until = time.time() + 20
    while shuffle_files() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files() - before
    rows = [tuple(r) for r in reached.collect() if r.url is not None]
    assert len(rows) == len(set(rows)) and {(t, u): d for t, u, d in rows} == {k: d for k, d in want.items() if k[1] is not None}
    assert expand_frontier(seeds.limit(0), edges).count() == 0
