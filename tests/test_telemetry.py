import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.operators import ordered
from webloom.operators import telemetry as tel

S = tel.SECOND


@pytest.fixture(scope="module")
def log(spark):
    """A skewed log: one domain holds most rows; times repeat and leave gaps."""
    rng = random.Random(7)
    rows, us = [], 0
    for i in range(3000):
        us += rng.choice([0, 1_000, 200_000, 3_000_000, 40_000_000 if i % 97 == 0 else 500_000])
        domain = "hot" if rng.random() < 0.7 else f"d{rng.randrange(4)}"
        status = rng.choice([200] * 8 + [429, 403, 503, 500])
        rows.append((i, us, domain, status, float(rng.randrange(100, 2500)), f"p{rng.randrange(2)}", 4.0))
    schema = "fetch_id bigint, us bigint, domain string, status int, latency_ms double, proxy_url string, base_qps double"
    return spark.createDataFrame(rows, schema).repartition(7).cache()


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_trailing_sums_equal_a_plain_window(log):
    width = 30 * S
    w = Window.partitionBy("domain").orderBy("us").rangeBetween(-width + 1, 0)
    plain = log.select("fetch_id", F.count("*").over(w), F.sum((F.col("status") == 429).cast("int")).over(w))
    for rows in (7, 100, None):
        got = ordered.trailing_sums(
            log, ["domain"], "us", width, {"n": F.lit(1), "bad": (F.col("status") == 429).cast("int")}, rows
        )
        same(got.select("fetch_id", "n", "bad"), plain)


def test_chunked_scans_equal_plain_windows(log):
    w = Window.partitionBy("domain").orderBy("us", "fetch_id")
    chunk = ordered.time_chunk(F.col("us"), 60)
    keys, order = ["domain"], ["us", "fetch_id"]
    same(
        ordered.previous_row(log, keys, order, {"prev": "status"}, chunk).select("fetch_id", "prev"),
        log.select("fetch_id", F.lag("status").over(w)),
    )
    same(
        ordered.running_count(log, keys, order, "i", chunk).select("fetch_id", "i"),
        log.select("fetch_id", F.row_number().over(w)),
    )
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    same(
        ordered.running_max_before(log, keys, order, "latency_ms", "m", chunk).select("fetch_id", F.coalesce("m", F.lit(0.0))),
        log.select("fetch_id", F.coalesce(F.max("latency_ms").over(before), F.lit(0.0))),
    )


def test_rows_without_key_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 200), ("a", 2, 500), (None, 3, 500)], "proxy_url string, fetch_id int, status int")
    df = df.withColumn("us", F.col("fetch_id") * S)
    assert tel.proxy_runs(df, 1).count() == 3
    chunk = ordered.time_chunk(F.col("us"), 1)
    before = ordered.previous_row(df, ["proxy_url"], ["us"], {"p": "status"}, chunk)
    assert {r.fetch_id: r.p for r in before.collect()} == {1: None, 2: None, 3: 200}
    assert {r.fetch_id: r.i for r in ordered.running_count(df, ["proxy_url"], ["us"], "i", chunk).collect()} == {1: 1, 2: 1, 3: 2}


def test_fetches_without_domain_belong_to_default(log):
    blank = log.withColumn("domain", F.when(F.col("fetch_id") % 4 == 0, "").when(F.col("fetch_id") % 4 > 1, F.col("domain")))
    named = blank.withColumn("domain", F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("default")))
    got, want = ({(r.domain, r.fetch_id, r.qps) for r in tel.adaptive_trace(x).collect()} for x in (blank, named))
    assert got == want and len(got) == log.count() and any(d == "default" for d, _, _ in got)


def test_chunk_length_follows_the_busiest_key(log):
    n = ordered.fitting_chunk_seconds(log, ["domain"], "us", rows=200)
    assert 60 <= n < ordered.fitting_chunk_seconds(log, ["domain"], "us", rows=2000)
    assert ordered.fitting_chunk_seconds(log.limit(0), ["domain"], "us", rows=1) == 60


def test_equal_chunks_bound_the_largest_group(spark):
    """Nine tenths of the rows under one key, most of them within one second."""
    hot = [("hot", int(1e12) + (i if i % 10 else i * 1_000_000)) for i in range(9000)]
    rows = hot + [(f"k{i % 40}", i * 1_000_000) for i in range(900)] + [(None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, us bigint")
    got, many = ordered.equal_chunks(df, ["k"], "us", rows=300)
    sizes = {(r["k"], r["_chunk"]): r["count"] for r in got.groupBy("k", "_chunk").count().collect()}
    assert many and sum(sizes.values()) == len(rows) and max(sizes.values()) <= 330
    assert 25 <= sum(k == "hot" for k, _ in sizes) <= 35 and (None, 0) in sizes
    spans = got.groupBy("k", "_chunk").agg(F.min("us").alias("a"), F.max("us").alias("b")).orderBy("k", "_chunk").collect()
    assert all(x["k"] != y["k"] or x["b"] < y["a"] for x, y in zip(spans, spans[1:]))
    assert not ordered.equal_chunks(df, ["k"], "us")[1]


def test_scans_in_equal_chunks_equal_plain_windows(log):
    keys, order, w = ["domain"], ["us", "fetch_id"], Window.partitionBy("domain").orderBy("us", "fetch_id")
    same(ordered.previous_row(log, keys, order, {"prev": "status"}, rows=20).select("fetch_id", "prev"), log.select("fetch_id", F.lag("status").over(w)))
    same(ordered.running_count(log, keys, order, "i", rows=20).select("fetch_id", "i"), log.select("fetch_id", F.row_number().over(w)))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    odd = log.withColumn("v", F.when(F.col("fetch_id") % 5 == 0, F.col("us")))
    same(ordered.next_value(odd, keys, order, "v", "n", rows=20).select("fetch_id", "n"), odd.select("fetch_id", F.min("v").over(later)))


def pool_replay(rows, limit=3):
    """Evictions and the proxies out of use at the end, report by report."""
    pool = {r[0] for r in rows if r[0]}
    out, run, evictions = set(), dict.fromkeys(pool, 0), dict.fromkeys(pool, 0)
    for proxy, status, *_ in sorted(rows, key=lambda r: (r[2], r[3])):
        if not proxy:
            continue
        run[proxy] = 0 if status is not None and status < 500 and status != 407 else run[proxy] + 1
        if run[proxy] >= limit and proxy not in out:
            out.add(proxy)
            evictions[proxy] += 1
        if out == pool:
            out, run = set(), dict.fromkeys(pool, 0)
    return {p: (evictions[p], p not in out) for p in pool}


@pytest.mark.parametrize("rows", [3, None])
@pytest.mark.parametrize("seed", range(3))
def test_proxy_totals_with_revivals(spark, seed, rows):
    rng = random.Random(seed)
    log = [(rng.choice(["a", "b", "c", None]), rng.choice([200, 200, 500, 503, 407, None]), i // 2, i) for i in range(400)]
    df = spark.createDataFrame(log, "proxy_url string, status int, us bigint, fetch_id bigint")
    got = tel.proxy_totals(df, rows=rows).collect()
    assert {r.proxy_url: (r.evictions, r.healthy) for r in got} == pool_replay(log)
    assert sum(r.evictions for r in got) > 6
    assert {r.proxy_url: r.hits for r in got} == {p: sum(x[0] == p for x in log) for p in "abc"}


def test_two_rounds_of_evictions(spark):
    fails = [(p, 500) for p in ("a", "b") for _ in range(3)]
    log = [(p, s, i, i) for i, (p, s) in enumerate([*fails, ("a", 200), ("b", 200), *fails])]
    df = spark.createDataFrame(log, "proxy_url string, status int, us bigint, fetch_id bigint")
    assert tuple(tel.pool_totals(tel.proxy_totals(df)).first()) == (2, 14, 12, 4, 2)
    assert tel.proxy_totals(df.limit(0)).collect() == []


def test_failure_runs(log):
    rows = sorted(log.collect(), key=lambda r: (r.us, r.fetch_id))
    run, want, first = {}, {}, {}
    for r in rows:
        run[r.proxy_url] = 0 if r.status < 500 else run.get(r.proxy_url, 0) + 1
        want[r.fetch_id] = run[r.proxy_url]
        if run[r.proxy_url] == 3:
            first.setdefault(r.proxy_url, r.fetch_id)
    for size in (2, 45, 100_000):
        runs = tel.proxy_runs(log, size)
        assert {r.fetch_id: r.consec for r in runs.collect()} == want
    assert {r.proxy_url: r.fetch_id for r in tel.proxy_evictions(runs).collect()} == first


def replay(rows, width=30 * S):
    """Rate after every fetch, the plain way."""
    out, state = {}, {}
    for r in rows:
        seen, cur = state.setdefault(r.domain, ([], None))
        seen.append(r)
        peers = [x for x in rows if x.domain == r.domain and r.us - width < x.us <= r.us]
        ratio = sum(x.status in (429, 403) for x in peers) / len(peers)
        avg = sum(x.latency_ms for x in peers) / len(peers)
        f = 0.5 if ratio >= 0.2 else 0.75 if ratio >= 0.05 else 0.85 if avg > 1500 else 1.08 if ratio == 0 and avg < 400 else 1.0
        cur = min(r.base_qps, max(0.2, (cur or r.base_qps) * f))
        state[r.domain] = (seen, cur)
        out[r.fetch_id] = cur
    return out


def test_adaptive_trace(log):
    rows = sorted(log.collect(), key=lambda r: (r.us, r.fetch_id))
    want = replay(rows)
    for block in (2, 5, 64, None):
        got = {r.fetch_id: r.qps for r in tel.adaptive_trace(log, block=block).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_eight_blocks_lower_the_rate(spark):
    rows = [(i, i * S, "x", 429, 50.0, 4.0) for i in range(8)]
    df = spark.createDataFrame(rows, "fetch_id bigint, us bigint, domain string, status int, latency_ms double, base_qps double")
    last = tel.adaptive_trace(df).orderBy(F.desc("us")).first()
    assert last.qps == 0.2


def admit(rows, q):
    """Token bucket, request by request."""
    tokens, last, out = q, rows[0].us / S, {}
    for r in rows:
        now = max(r.us / S, last)
        tokens = min(2 * q, tokens + (now - last) * q)
        if tokens < 1:
            now, tokens = now + (1 - tokens) / q, 1
        tokens, last = tokens - 1, now
        out[r.id] = now - rows[0].us / S
    return out


def test_token_bucket(log):
    for q in (0.7, 2.0, 50.0):
        requests = log.select(F.col("fetch_id").alias("id"), "domain", "us").withColumn("qps", F.lit(q))
        got = {r.id: r.admit_s for r in tel.admit_times(requests).collect()}
        by_domain = {}
        for r in sorted(requests.collect(), key=lambda r: (r.us, r.id)):
            by_domain.setdefault(r.domain, []).append(r)
        for rows in by_domain.values():
            for k, v in admit(rows, q).items():
                assert abs(got[k] - v) < 1e-6
    slow = log.select(F.col("fetch_id").alias("id"), "domain", "us", F.lit(0.2).alias("qps"))
    assert tel.admit_times(slow).filter("admit_s IS NOT NULL").count() == 0


def test_three_permits_at_fifty_per_second(spark):
    rows = spark.createDataFrame([(i, "d", 0, 50.0) for i in range(3)], "id int, domain string, us bigint, qps double")
    assert tel.admit_times(rows).agg(F.max("admit_s")).first()[0] < 1


def test_round_robin_is_even(spark):
    req = spark.range(9).select(F.col("id"), F.lit("p").alias("pool"), (F.col("id") * S).alias("us"))
    pool = F.array(*[F.lit(x) for x in "abc"])
    got = tel.round_robin(req, ["pool"], ["us", "id"], pool, ordered.time_chunk(F.col("us"), 2))
    assert {r.assigned: r["count"] for r in got.groupBy("assigned").count().collect()} == {"a": 3, "b": 3, "c": 3}


def test_counters(spark):
    rows = [(1, 200, False, 3), (1, 503, False, 9), (1, None, False, 9), (1, 200, True, 9), (2, 404, False, 0)]
    df = spark.createDataFrame(rows, "task_id int, status int, robots_skip boolean, results int")
    got = {r.task_id: tuple(r)[1:] for r in tel.task_counters(df).collect()}
    assert got == {1: (2, 2, 3, 1), 2: (1, 1, 0, 0)}
    stats = {r.task_id: r.stats for r in tel.stats_map(tel.task_counters(df)).collect()}
    assert stats[2] == {"crawled": 1, "failed": 1}


def test_node_state_keeps_metrics_over_heartbeats(spark):
    rows = [("w", 1, 1, "metrics", "", "", 5.0, 6.0, 7.0, 0.5), ("w", 2, 2, "heartbeat", "", "degraded", 0.0, 0.0, 0.0, 0.0),
            ("v", 9, 3, "heartbeat", "boss", "", 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(
        rows, "worker_id string, us bigint, id int, kind string, role string, status string, cpu double, memory_mb double, "
        "pages_per_min double, fail_rate double",
    )
    got = {r.worker_id: tuple(r)[1:] for r in tel.node_state(df).collect()}
    assert got["w"] == ("worker", "degraded", 2, 5.0, 6.0, 7.0, 0.5)
    assert got["v"] == ("boss", "online", 9, 0.0, 0.0, 0.0, 0.0)
    stale = tel.mark_stale(tel.node_state(df), F.lit(9 + 20 * S)).collect()
    assert {r.worker_id: r.status for r in stale} == {"w": "offline", "v": "online"}
    empty = tel.cluster_totals(tel.node_state(df.limit(0))).first()
    assert tuple(empty) == (0, 0.0, 0.0)


def test_recent_points(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("us"))
    assert tel.recent_points(df, ["k"], ["us"], 3).count() == 60
    assert tel.recent_points(df, ["k"], ["us"], 40).agg(F.min("us")).first()[0] == 60
