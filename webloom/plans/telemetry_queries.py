"""Queries over fetch logs, job queue, nodes and proxies (A, W, J1-J3, J8-J12, T2-T3, U, P13-P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.clock import micros
from webloom.operators import dedup, queue, spans
from webloom.operators import telemetry as tel
from webloom.plans.registry import query
from webloom.plans.views import with_tables
from webloom.session import work_folder
from webloom.streaming import frames
from webloom.streaming import windows as stream

HOUR, DAY = 3_600_000_000, 86_400_000_000
# 2024-01-30 12:00:00 in epoch microseconds: "now" of the queries that need one.
NOW_US = 1_706_616_000_000_000
NOW_S = 883_612_800  # 1998-01-01, inside the lease dates


def _six(name: str):
    """Six decimals; the small surplus keeps halves on one side whatever the order of summation."""
    return (F.floor(F.col(name) * 1_000_000 + 0.5001) / 1_000_000).alias(name)


# Counters -------------------------------------------------------------------------------------


@query(
    "a1_task_counters",
    with_tables("fetch_log")
    + """SELECT task_id, count(*) FILTER (ok) AS crawled, count(*) FILTER ((ok AND status >= 400) OR lost) AS failed,
                CAST(coalesce(sum(fetch_id % 4) FILTER (ok AND status < 400), 0) AS BIGINT) AS results,
                count(*) FILTER (skip) AS robots_skip
         FROM (SELECT *, fetch_id % 13 = 0 AS skip, fetch_id % 17 = 0 AND fetch_id % 13 <> 0 AS lost,
                      fetch_id % 17 <> 0 AND fetch_id % 13 <> 0 AS ok FROM fetch_log) GROUP BY task_id""",
)
def task_counters(t):
    return tel.task_counters(_outcomes(t))


def _outcomes(t):
    k = F.col("fetch_id")
    return t.fetch_log.select(
        "task_id",
        F.when(k % 17 != 0, F.col("status")).alias("status"),
        (k % 13 == 0).alias("robots_skip"),
        (k % 4).alias("results"),
    )


@query("s6_node_state", with_tables("nodes") + "SELECT * FROM nodes")
def node_state(t):
    return tel.node_state(t.node_reports)


@query(
    "p13_stale_nodes",
    with_tables("nodes")
    + f"SELECT worker_id, CASE WHEN last_seen_us < {NOW_US} + 36 * {HOUR} - 600000000 THEN 'offline' ELSE status END AS status FROM nodes",
)
def stale_nodes(t):
    nodes = tel.mark_stale(tel.node_state(t.node_reports), F.lit(NOW_US + 36 * HOUR), 600_000_000)
    return nodes.select("worker_id", "status")


@query(
    "p14_unexpired",
    with_tables("task_events")
    + f"""SELECT id, 'snapshot' AS kind FROM task_events WHERE {NOW_US} - us <= 1800000000
          UNION ALL SELECT id, 'robots' FROM task_events WHERE {NOW_US} - us <= 600000000""",
)
def unexpired(t):
    now = F.lit(NOW_US)
    kinds = {"snapshot": 1_800_000_000, "robots": 600_000_000}
    parts = [
        tel.unexpired(t.task_events, "us", now, ttl).select("id", F.lit(k).alias("kind")) for k, ttl in kinds.items()
    ]
    return parts[0].union(parts[1])


@query(
    "a2_cluster_totals",
    with_tables("nodes")
    + """SELECT count(*) AS nodes, round(sum(pages_per_min), 4) AS pages_per_min,
                floor(avg(fail_rate) * 1000000 + 0.5001) / 1000000 AS fail_rate FROM nodes""",
)
def cluster_totals(t):
    out = tel.cluster_totals(tel.node_state(t.node_reports))
    return out.select("nodes", F.round("pages_per_min", 4).alias("pages_per_min"), _six("fail_rate"))


@query(
    "a3_queue_stats",
    with_tables("jobs")
    + """SELECT count(*) FILTER (lease_expiry IS NULL) AS ready, count(*) FILTER (lease_expiry IS NOT NULL) AS leased,
                CAST(sum(reclaims) AS BIGINT) AS reclaim_total FROM jobs""",
)
def queue_stats(t):
    return queue.queue_stats(t.jobs)


@query("a3_pending_per_task", with_tables("jobs") + "SELECT task_id, count(*) AS pending FROM jobs GROUP BY task_id")
def pending_per_task(t):
    return queue.pending_per_task(t.jobs)


def _pool_log(t):
    """Reports of three proxies that all fail now and then, so the pool is evicted and revived again and again."""
    return t.events.select(
        F.col("event_id").alias("fetch_id"), micros(F.col("ts")).alias("us"),
        F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("proxy-"), (F.col("user_id") % 3 + 1).cast("string"))).alias("proxy_url"),
        F.when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 407).otherwise(200).alias("status"),
    )


_POOL = with_tables(
    l="""SELECT 'proxy-' || CAST(user_id % 3 + 1 AS VARCHAR) AS proxy_url, event_type IN ('error', 'signup') AS bad,
                row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE event_id % 11 <> 0""",
    g="""SELECT *, bad AND lag(bad, 1) OVER w AND lag(bad, 2) OVER w AS ends, lag(rn, 2) OVER w AS s,
                sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY proxy_url ORDER BY rn ROWS UNBOUNDED PRECEDING) AS island
         FROM l WINDOW w AS (PARTITION BY proxy_url ORDER BY rn)""",
    span="SELECT proxy_url, s, rn AS e FROM g WHERE ends",
    size="SELECT count(DISTINCT proxy_url) AS n FROM l",
    round="""SELECT 0::BIGINT AS k, 0::BIGINT AS t UNION ALL
             SELECT k + 1, max(e) FROM (SELECT k, proxy_url, min(e) AS e FROM round JOIN span ON s > t GROUP BY k, proxy_url), size
             GROUP BY k, n HAVING count(*) = n""",
    last="SELECT max(k) AS k, max(t) AS t FROM round",
    proxy="""SELECT l.proxy_url, count(*) AS hits, count(*) FILTER (bad) AS fails, (SELECT max(r) FROM (SELECT count(*) FILTER (bad) AS r FROM g
                 WHERE g.proxy_url = l.proxy_url GROUP BY island)) AS longest_run FROM l GROUP BY l.proxy_url""",
    gone="SELECT DISTINCT proxy_url FROM span, last WHERE s > t",
    recursive=True,
)
_POOL_ROWS = """SELECT proxy.*, last.k + CASE WHEN gone.proxy_url IS NULL THEN 0 ELSE 1 END AS evictions, gone.proxy_url IS NULL AS healthy
    FROM last, proxy LEFT JOIN gone ON gone.proxy_url = proxy.proxy_url"""


@query("a5_proxy_totals", _POOL + _POOL_ROWS, evictions="BIGINT")
def proxy_totals(t):
    return tel.proxy_totals(_pool_log(t))


@query(
    "a5_pool_totals",
    _POOL
    + f"""SELECT count(*) AS size, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(fails) AS BIGINT) AS fails,
                 CAST(sum(evictions) AS BIGINT) AS evictions, count(*) FILTER (healthy) AS healthy FROM ({_POOL_ROWS})""",
)
def pool_totals(t):
    return tel.pool_totals(tel.proxy_totals(_pool_log(t)))


@query(
    "w5_failure_runs",
    with_tables(
        "fetch_log",
        g="""SELECT *, sum(CASE WHEN status < 500 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY proxy_url ORDER BY us, fetch_id ROWS UNBOUNDED PRECEDING) AS island FROM fetch_log""",
    )
    + """SELECT fetch_id, proxy_url, CAST(CASE WHEN status < 500 THEN 0 ELSE
                count(*) FILTER (status >= 500) OVER (PARTITION BY proxy_url, island ORDER BY us, fetch_id
                    ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS consec FROM g""",
)
def failure_runs(t):
    return tel.proxy_runs(t.fetch_log).select("fetch_id", "proxy_url", "consec")


@query(
    "w5_proxy_evictions",
    with_tables("fetch_log")
    + """SELECT proxy_url, min(us) AS evicted_us, min(fetch_id) AS fetch_id FROM (
           SELECT proxy_url, us, fetch_id, status, lag(status, 1) OVER w AS s1, lag(status, 2) OVER w AS s2
           FROM fetch_log WINDOW w AS (PARTITION BY proxy_url ORDER BY us, fetch_id))
         WHERE status >= 500 AND s1 >= 500 AND s2 >= 500 GROUP BY proxy_url""",
)
def proxy_evictions(t):
    return tel.proxy_evictions(tel.proxy_runs(t.fetch_log))


_RR = """SELECT fetch_id, us, (row_number() OVER (ORDER BY us, fetch_id) - 1) % 3 AS slot FROM fetch_log"""


@query(
    "w6_round_robin",
    with_tables("fetch_log") + f"SELECT fetch_id, 'proxy-' || CAST(slot + 1 AS VARCHAR) AS assigned FROM ({_RR})",
)
def round_robin(t):
    return _assigned(t).select("fetch_id", "assigned")


def _assigned(t):
    pool = F.array(*[F.lit(f"proxy-{i}") for i in (1, 2, 3)])
    log = t.fetch_log.select("fetch_id", "us").withColumn("pool", F.lit("main"))
    return tel.round_robin(log, ["pool"], ["us", "fetch_id"], pool)


@query(
    "a13_balance",
    with_tables("fetch_log")
    + f"SELECT 'proxy-' || CAST(slot + 1 AS VARCHAR) AS assigned, count(*) AS hits FROM ({_RR}) GROUP BY slot",
)
def balance(t):
    return _assigned(t).groupBy("assigned").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "j9_shared_hits",
    with_tables("fetch_log")
    + """SELECT l.worker_id, l.proxy_url, greatest(l.hits, s.hits) AS hits FROM
           (SELECT worker_id, proxy_url, count(*) AS hits FROM fetch_log GROUP BY 1, 2) l LEFT JOIN
           (SELECT proxy_url, count(*) // 4 AS hits FROM fetch_log GROUP BY 1) s ON l.proxy_url = s.proxy_url""",
)
def shared_hits(t):
    """Counters of every worker against a shared one that holds a quarter of all hits."""
    local = t.fetch_log.groupBy("worker_id", "proxy_url").agg(F.count(F.lit(1)).alias("hits"))
    shared = t.fetch_log.groupBy("proxy_url").agg(F.floor(F.count(F.lit(1)) / 4).alias("hits"))
    return tel.shared_hits(local, shared).select("worker_id", "proxy_url", "hits")


@query(
    "a11_recent_throughput",
    with_tables("fetch_log")
    + f"""SELECT worker_id, count(*) AS pages, count(*) FILTER (status >= 400) AS fails,
                 floor(count(*) FILTER (status >= 400) / count(*) * 1000 + 0.5) / 1000 AS fail_rate
          FROM fetch_log WHERE us > {NOW_US} - {DAY} AND us <= {NOW_US} GROUP BY worker_id""",
)
def recent_throughput(t):
    return tel.recent_throughput(t.fetch_log, NOW_US, DAY)


@query(
    "a12_worker_totals",
    with_tables("fetch_log")
    + f"""SELECT worker_id, count(*) AS pages, count(*) FILTER (status >= 400) AS fails,
                 round(count(*) / (({NOW_US} - 1704067200000000) / 60000000.0), 6) AS pages_per_min
          FROM fetch_log GROUP BY worker_id""",
)
def worker_totals(t):
    out = tel.worker_totals(t.fetch_log, F.lit(1_704_067_200_000_000), F.lit(NOW_US))
    return out.withColumn("pages_per_min", F.round("pages_per_min", 6))


# Windows --------------------------------------------------------------------------------------


@query(
    "w1_block_window",
    with_tables("fetch_log")
    + f"""SELECT fetch_id, domain, count(*) OVER w AS total, count(*) FILTER (status IN (429, 403)) OVER w AS blocked,
                 CAST(sum(CAST(round(latency_ms * 1000) AS BIGINT)) OVER w AS BIGINT) AS latency_us
          FROM fetch_log WINDOW w AS (PARTITION BY domain ORDER BY us RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)""",
)
def block_window(t):
    return tel.block_trace(t.fetch_log, HOUR).select("fetch_id", "domain", "total", "blocked", "latency_us")


@query(
    "w2_throughput_window",
    with_tables("fetch_log")
    + f"""SELECT fetch_id, worker_id, count(*) OVER w AS pages, count(*) FILTER (status >= 400) OVER w AS fails,
                 floor(count(*) FILTER (status >= 400) OVER w / count(*) OVER w * 1000 + 0.5) / 1000 AS fail_rate
          FROM fetch_log WINDOW w AS (PARTITION BY worker_id ORDER BY us RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)""",
)
def throughput_window(t):
    return tel.throughput_trace(t.fetch_log, DAY).select("fetch_id", "worker_id", "pages", "fails", "fail_rate")


@query(
    "w3_recent_points",
    with_tables("node_reports")
    + """SELECT worker_id, us, cpu FROM (SELECT *, row_number() OVER (PARTITION BY worker_id ORDER BY us DESC, id DESC) AS rn
         FROM node_reports WHERE kind = 'metrics') WHERE rn <= 40""",
)
def recent_points(t):
    reports = t.node_reports.filter("kind = 'metrics'")
    return tel.recent_points(reports, ["worker_id"], ["us", "id"], 40).select("worker_id", "us", "cpu")


@query(
    "w4_adaptive_rate",
    with_tables(
        "fetch_log",
        w=f"""SELECT fetch_id, domain, row_number() OVER (PARTITION BY domain ORDER BY us, fetch_id) AS rn,
                    count(*) FILTER (status IN (429, 403)) OVER r / count(*) OVER r AS ratio,
                    avg(CAST(round(latency_ms * 1000) AS BIGINT)) OVER r / 1000 AS avg_ms
             FROM fetch_log WINDOW r AS (PARTITION BY domain ORDER BY us RANGE BETWEEN {HOUR - 1} PRECEDING AND CURRENT ROW)""",
        s="""SELECT *, CASE WHEN ratio >= 0.2 THEN 0.5 WHEN ratio >= 0.05 THEN 0.75 WHEN avg_ms > 1500 THEN 0.85
                    WHEN ratio = 0 AND avg_ms < 400 THEN 1.08 ELSE 1.0 END::DOUBLE AS factor FROM w""",
        f="""SELECT domain, rn, fetch_id, factor, least(4.0, greatest(0.2, 4.0 * factor))::DOUBLE AS qps FROM s WHERE rn = 1
             UNION ALL SELECT s.domain, s.rn, s.fetch_id, s.factor, least(4.0, greatest(0.2, f.qps * s.factor))::DOUBLE
             FROM f JOIN s ON s.domain = f.domain AND s.rn = f.rn + 1""",
        recursive=True,
    )
    + "SELECT fetch_id, domain, factor, round(qps, 6) AS qps FROM f",
)
def adaptive_rate(t):
    log = t.fetch_log.withColumn("base_qps", F.lit(4.0))
    out = tel.adaptive_trace(log, HOUR)
    return out.select("fetch_id", "domain", "factor", F.round("qps", 6).alias("qps"))


@query(
    "w10_burst_plan",
    with_tables("fetch_log")
    + """SELECT fetch_id, domain, round(greatest(0.0, (row_number() OVER (PARTITION BY domain ORDER BY us, fetch_id) - 2.5)
                / 2.5), 6) AS admit_s FROM fetch_log""",
)
def burst_plan(t):
    requests = t.fetch_log.select("fetch_id", "domain", "us").withColumn("qps", F.lit(2.5))
    out = tel.burst_plan(requests, ["us", "fetch_id"])
    return out.select("fetch_id", "domain", F.round("admit_s", 6).alias("admit_s"))


@query(
    "w10_token_bucket",
    with_tables(
        "fetch_log",
        q="""SELECT fetch_id, domain, us // 20000 AS us,
                    CAST(substr(domain, 2) AS INT) % 5 + 1.0 AS qps FROM fetch_log""",
        a="""SELECT *, (us - min(us) OVER (PARTITION BY domain)) / 1000000.0 AS sec,
                    row_number() OVER (PARTITION BY domain ORDER BY us, fetch_id) AS rn FROM q""",
        b="""SELECT domain, rn, fetch_id, sec, qps::DOUBLE AS qps, sec::DOUBLE AS admit, (qps - 1)::DOUBLE AS tokens
             FROM a WHERE rn = 1
             UNION ALL
             SELECT domain, rn, fetch_id, sec, qps, CASE WHEN have >= 1 THEN at ELSE at + (1 - have) / qps END,
                    CASE WHEN have >= 1 THEN have - 1 ELSE 0 END
             FROM (SELECT a.domain, a.rn, a.fetch_id, a.sec, b.qps, greatest(a.sec, b.admit)::DOUBLE AS at,
                          least(2 * b.qps, b.tokens + (greatest(a.sec, b.admit) - b.admit) * b.qps)::DOUBLE AS have
                   FROM b JOIN a ON a.domain = b.domain AND a.rn = b.rn + 1)""",
        recursive=True,
    ).replace(" AS at,", " AS now_s,").replace("THEN at ELSE at +", "THEN now_s ELSE now_s +")
    + "SELECT fetch_id, domain, floor((admit - sec) * 1000000 + 0.5001) / 1000000 AS wait_s FROM b",
)
def token_bucket(t):
    """Arrivals squeezed in time by 20000, so that buckets do run empty."""
    requests = t.fetch_log.select(
        F.col("fetch_id").alias("id"), "domain", F.floor(F.col("us") / 20_000).alias("us"),
        (F.substring("domain", 2, 9).cast("int") % 5 + 1.0).alias("qps"),
    )
    out = tel.admit_times(requests)
    return out.select(F.col("id").alias("fetch_id"), "domain", _six("wait_s"))


@query(
    "w11_rate_audit",
    with_tables(
        "fetch_log",
        s="""SELECT domain, count(*) AS requests, (max(us) - min(us)) / 1000000.0 AS span_s FROM fetch_log GROUP BY domain""",
    )
    + """SELECT domain, requests, round((requests - 1) / span_s, 9) AS observed_qps,
                (requests - 1) / span_s BETWEEN 0.00018 * 0.9 AND 0.00018 * 1.1 AS within FROM s""",
)
def rate_audit(t):
    out = tel.rate_audit(t.fetch_log, F.lit(0.00018))
    return out.select("domain", "requests", F.round("observed_qps", 9).alias("observed_qps"), "within")


@query(
    "w12_cpu_percent",
    with_tables(
        "fetch_log",
        c="""SELECT fetch_id, worker_id, us, CASE WHEN fetch_id % 97 = 0 THEN 5 ELSE fetch_id * 200000000 END AS usec
             FROM fetch_log""",
        p="SELECT *, lag(usec) OVER w AS u0, lag(us) OVER w AS t0 FROM c WINDOW w AS (PARTITION BY worker_id ORDER BY us, fetch_id)",
    )
    + """SELECT fetch_id, worker_id, round(CASE WHEN u0 IS NULL OR u0 = 0 OR us <= t0 THEN 0.0 WHEN usec < u0 THEN 400.0
                ELSE least(400.0, (usec - u0) / (us - t0) * 100) END, 6) AS cpu FROM p""",
)
def cpu_percent(t):
    k = F.col("fetch_id")
    usec = F.when(k % 97 == 0, 5).otherwise(k * 200_000_000)
    samples = t.fetch_log.select(k.alias("id"), "worker_id", "us", usec.alias("usec"))
    return tel.cpu_percent(samples).select(F.col("id").alias("fetch_id"), "worker_id", F.round("cpu", 6).alias("cpu"))


# Queue ----------------------------------------------------------------------------------------


def _lookup_tables(t):
    """Jobs next to the tasks of solvent customers and the faster rules: some of both are missing."""
    solvent = t.customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    tasks = t.tasks.join(solvent, "id", "left_semi").select(
        F.col("id").alias("task_id"), "status", F.lit(2).alias("max_depth")
    )
    rules = t.rules.filter("qps >= 1").select(F.col("id").alias("rule_id"), "qps", F.lit(True).alias("respect_robots"))
    jobs = t.jobs.select("id", "task_id", (F.col("task_id") % 150).alias("rule_id"))
    return jobs, tasks, rules


_J1 = with_tables(
    "jobs", "tasks", "rules",
    j="SELECT id, task_id, task_id % 150 AS rule_id FROM jobs",
    tk="SELECT id AS task_id, status FROM tasks WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    r="SELECT id AS rule_id, qps FROM rules WHERE qps >= 1",
)


@query(
    "j1_job_lookup",
    _J1 + """SELECT j.id, tk.status AS task_status, r.qps AS rule_qps FROM j LEFT JOIN tk ON j.task_id = tk.task_id
             LEFT JOIN r ON j.rule_id = r.rule_id""",
)
def job_lookup(t):
    return queue.job_lookup(*_lookup_tables(t)).select("id", "task_status", "rule_qps")


@query(
    "j1_missing_references",
    _J1 + """SELECT id, CASE WHEN task_id NOT IN (SELECT task_id FROM tk) THEN 'task' ELSE 'rule' END AS missing FROM j
             WHERE task_id NOT IN (SELECT task_id FROM tk) OR rule_id NOT IN (SELECT rule_id FROM r)""",
)
def missing_references(t):
    return queue.missing_references(*_lookup_tables(t)).select("id", "missing")


@query("t2_job_order", with_tables("jobs") + "SELECT id, task_id, priority, enqueued_at FROM jobs")
def job_order(t):
    return queue.in_job_order(t.jobs).select("id", "task_id", "priority", "enqueued_at")


@query(
    "t3_take_next",
    with_tables("jobs")
    + """SELECT id, priority, 'worker-1' AS owner, CAST(1000030 AS BIGINT) AS lease_expiry FROM jobs
         WHERE lease_expiry IS NULL
         ORDER BY -CAST(priority AS DOUBLE) * 1e13 + CAST(enqueued_at AS DOUBLE) + attempt * CAST(0.001 AS DOUBLE), id LIMIT 25""",
)
def take_next(t):
    ready = t.jobs.filter("lease_expiry IS NULL")
    return queue.take_next(ready, 25, "worker-1", 1_000_000, 90).select("id", "priority", "owner", "lease_expiry")


@query(
    "u4_reclaim",
    with_tables("jobs")
    + f"""SELECT id, CASE WHEN lease_expiry IS NULL THEN priority ELSE 0 END AS priority,
                 CASE WHEN lease_expiry IS NULL THEN enqueued_at ELSE {NOW_S} END AS enqueued_at,
                 lease_expiry IS NOT NULL AS reclaimed
          FROM jobs WHERE lease_expiry IS NULL OR lease_expiry <= {NOW_S}""",
)
def reclaim(t):
    return queue.reclaim(t.jobs, F.lit(NOW_S)).select("id", "priority", "enqueued_at", "reclaimed")


@query(
    "u5_acknowledge",
    with_tables("jobs") + "SELECT id, task_id FROM jobs WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')",
)
def acknowledge(t):
    acked = t.lineitem.filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return queue.acknowledge(t.jobs, acked).select("id", "task_id")


_CANCELLED = "SELECT id AS task_id FROM tasks WHERE status = 'failed'"


@query(
    "j12_drop_cancelled",
    with_tables("jobs", "tasks") + f"SELECT id, task_id FROM jobs WHERE task_id NOT IN ({_CANCELLED})",
)
def drop_cancelled(t):
    return queue.drop_tasks(t.jobs, _cancelled(t)).select("id", "task_id")


def _cancelled(t):
    return t.tasks.filter("status = 'failed'").select(F.col("id").alias("task_id"))


@query(
    "j12_dropped_counts",
    with_tables("jobs", "tasks")
    + f"SELECT task_id, count(*) AS dropped FROM jobs WHERE task_id IN ({_CANCELLED}) GROUP BY task_id",
)
def dropped_counts(t):
    return queue.dropped_counts(t.jobs, _cancelled(t))


@query(
    "j8_idle_tasks",
    with_tables(
        "jobs", "tasks", "fetch_log",
        pending="SELECT DISTINCT task_id FROM jobs WHERE lease_expiry IS NOT NULL",
        stats="""SELECT task_id, count(*) FILTER (fetch_id % 17 <> 0 AND fetch_id % 13 <> 0) AS crawled
                 FROM fetch_log GROUP BY task_id""",
    )
    + """SELECT t.id AS task_id, s.crawled FROM tasks t JOIN stats s ON s.task_id = t.id
         WHERE status = 'running' AND t.id NOT IN (SELECT task_id FROM pending)""",
)
def idle_tasks(t):
    """Running tasks with no job in flight."""
    stats = tel.task_counters(_outcomes(t))
    tasks = t.tasks.withColumnRenamed("id", "task_id")
    return queue.idle_tasks(tasks, t.jobs.filter("lease_expiry IS NOT NULL"), stats).select("task_id", "crawled")


@query(
    "w9_seed_jobs",
    with_tables(
        "tasks",
        s="""SELECT id AS task_id, rule_id, unnest(['http://s' || CAST(id % 7 AS VARCHAR) || '.example/', 'http://b.example/p?a=1&b=2',
                    'http://c.example/']) AS url, unnest([0, 1, 3]) AS pos FROM tasks""",
    )
    + "SELECT task_id, rule_id, url, CAST(0 AS INT) AS depth, CAST(10 - pos AS INT) AS priority FROM s",
)
def seed_jobs(t):
    seeds = F.array(
        F.concat(F.lit("HTTP://s"), (F.col("id") % 7).cast("string"), F.lit(".example")),
        F.lit("http://b.example/p?b=2&a=1"), F.lit(" "), F.lit("http://c.example/#x"),
    )
    return queue.seed_jobs(t.tasks.select(F.col("id").alias("task_id"), "rule_id", seeds.alias("seed_urls")))


# URLs seen ------------------------------------------------------------------------------------


def _offers(t):
    return t.crawl_results.select("task_id", "url")


def _seen(t):
    return t.crawl_results.filter("l_linenumber = 1").select("task_id", "url")


@query(
    "u1_distinct_urls",
    with_tables("crawl_results") + "SELECT DISTINCT task_id, url FROM crawl_results",
)
def distinct_urls(t):
    return dedup.distinct_urls(_offers(t))


_FRESH = """SELECT DISTINCT task_id, url FROM crawl_results
            EXCEPT SELECT task_id, url FROM crawl_results WHERE l_linenumber = 1"""


@query("j2_fresh_urls", with_tables("crawl_results") + _FRESH)
def fresh_urls(t):
    return dedup.fresh_urls(_offers(t), _seen(t))


@query(
    "j2_offer_counts",
    with_tables("crawl_results", fresh=_FRESH)
    + """SELECT task_id, count(*) AS offered, (SELECT count(*) FROM fresh f WHERE f.task_id = c.task_id) AS enqueued,
                count(*) - (SELECT count(*) FROM fresh f WHERE f.task_id = c.task_id) AS duplicated
         FROM crawl_results c GROUP BY task_id""",
)
def offer_counts(t):
    return dedup.offer_counts(_offers(t), _seen(t))


@query("j3_fresh_urls_by_bloom", with_tables("crawl_results") + _FRESH)
def fresh_urls_by_bloom(t):
    return dedup.fresh_urls_by_bloom(_offers(t), _seen(t), 1 << 18, 5)


_BITS = """SELECT DISTINCT task_id, (h1 + i * h2) % 4093 AS p FROM (
             SELECT task_id, ('0x' || substr(md5(url), 1, 8))::BIGINT AS h1, ('0x' || substr(md5(url), 9, 8))::BIGINT AS h2
             FROM (SELECT DISTINCT task_id, url FROM crawl_results WHERE l_linenumber = 1)), range(4) r(i)"""
_ALL_BITS = _BITS.replace(" WHERE l_linenumber = 1", "")


@query(
    "j3_maybe_seen",
    with_tables("crawl_results", bits=_BITS)
    + """SELECT o.task_id, o.url, bool_and(b.p IS NOT NULL) AS seen FROM (
           SELECT DISTINCT task_id, url, (('0x' || substr(md5(url), 1, 8))::BIGINT
                  + i * ('0x' || substr(md5(url), 9, 8))::BIGINT) % 4093 AS p FROM crawl_results, range(4) r(i)) o
         LEFT JOIN bits b ON b.task_id = o.task_id AND b.p = o.p GROUP BY o.task_id, o.url""",
)
def maybe_seen(t):
    bloom = dedup.build_bloom(_seen(t), 4093, 4, "md5")
    return dedup.maybe_seen(_offers(t), bloom, 4093, 4, "md5")


@query(
    "a6_bloom_sizing",
    with_tables(
        "crawl_results",
        n="SELECT task_id, count(DISTINCT url) AS n FROM crawl_results GROUP BY task_id",
        m="SELECT *, CAST(ceil(-n * ln(0.01) / pow(ln(2), 2)) AS BIGINT) AS m FROM n",
    )
    + "SELECT task_id, n, m, CAST(greatest(1, least(16, floor(m / n * ln(2) + 0.5))) AS INT) AS k FROM m",
)
def bloom_sizing(t):
    return dedup.bloom_sizing(_offers(t))


@query(
    "a7_bloom_pieces",
    with_tables("crawl_results", bits=_ALL_BITS.replace("4093", "95850583").replace("range(4)", "range(7)"))
    + """SELECT task_id, CASE WHEN p > 0 THEN 1 + (p - 1) // 32768 ELSE 0 END AS bucket, count(*) AS n_bits
         FROM bits GROUP BY 1, 2""",
)
def bloom_pieces(t):
    bloom = dedup.build_bloom(_offers(t), hasher="md5")
    return bloom.select("task_id", "bucket", F.bitmap_count("bits").alias("n_bits"))


@query(
    "a8_bloom_stats",
    with_tables("crawl_results", bits=_ALL_BITS, s="SELECT task_id, count(*) AS set_bits FROM bits GROUP BY task_id")
    + """SELECT task_id, set_bits, round(set_bits / 4093.0, 9) AS fill_ratio,
                round(-4093.0 / 4 * ln(1 - set_bits / 4093.0), 6) AS est_items, round(pow(set_bits / 4093.0, 4), 9) AS est_fp_rate
         FROM s""",
)
def bloom_stats(t):
    out = dedup.bloom_stats(dedup.build_bloom(_offers(t), 4093, 4, "md5"), 4093, 4)
    return out.select(
        "task_id", "set_bits", F.round("fill_ratio", 9).alias("fill_ratio"), F.round("est_items", 6).alias("est_items"),
        F.round("est_fp_rate", 9).alias("est_fp_rate"),
    )


# Batch runs of the streaming transformations ------------------------------------------------------


@query(
    "st1_sliding_throughput",
    with_tables(
        "fetch_log",
        x=f"SELECT *, unnest(range(24)) AS k, us - us % {HOUR} AS slot FROM fetch_log",
    )
    + f"""SELECT worker_id, slot - k * {HOUR} AS start_us, count(*) AS pages, count(*) FILTER (status >= 400) AS fails,
                 floor(count(*) FILTER (status >= 400) / count(*) * 1000 + 0.5) / 1000 AS fail_rate
          FROM x GROUP BY 1, 2""",
)
def sliding_throughput(t):
    hits = t.fetch_log.withColumn("ts", F.timestamp_micros("us"))
    out = stream.sliding_throughput(hits, "1 day", "1 hour")
    return out.select("worker_id", F.unix_micros("window_start").alias("start_us"), "pages", "fails", "fail_rate")


@query(
    "st3_distinct_offers",
    with_tables("crawl_results") + "SELECT DISTINCT task_id, url FROM crawl_results",
)
def distinct_offers(t):
    return stream.distinct_offers(t.crawl_results.select("task_id", "url"))


@query(
    "st8_running_counters",
    with_tables("fetch_log")
    + """SELECT task_id, count(*) AS crawled, count(*) FILTER (status >= 400) AS failed FROM fetch_log GROUP BY task_id""",
)
def running_counters(t):
    out = stream.running_counters(t.fetch_log.withColumns({"robots_skip": F.lit(False), "results": F.lit(0)}))
    return out.select("task_id", "crawled", "failed")


@query(
    "st9_cluster_series",
    with_tables(
        "node_reports",
        n=f"""SELECT us - us % {HOUR} AS frame_us, worker_id, arg_max(pages_per_min, us) AS ppm, arg_max(fail_rate, us) AS fr
              FROM node_reports WHERE kind = 'metrics' GROUP BY 1, 2""",
    )
    + """SELECT frame_us, round(sum(ppm), 4) AS pages_per_min, floor(avg(fr) * 1000000 + 0.5001) / 1000000 AS fail_rate
         FROM n GROUP BY frame_us
         ORDER BY frame_us DESC LIMIT 40""",
)
def cluster_series(t):
    reports = t.node_reports.filter("kind = 'metrics'").withColumn("ts", F.timestamp_micros("us"))
    points = tel.recent_cluster_points(stream.cluster_points(stream.frame_nodes(reports, "1 hour")))
    return points.select("frame_us", F.round("pages_per_min", 4).alias("pages_per_min"), _six("fail_rate"))


_LEASES = with_tables(
    "lease_events",
    n="""SELECT *, lead(us) OVER w AS next_us, lead(kind) OVER w AS next_kind, max(us) OVER () AS as_of FROM lease_events
         WINDOW w AS (PARTITION BY job_id ORDER BY us, id)""",
    e="""SELECT *, CASE WHEN next_us > expiry_us THEN 'expired' WHEN next_kind = 'lease' THEN 'renewed' WHEN next_us IS NOT NULL THEN 'acked'
                        WHEN expiry_us < as_of THEN 'expired' ELSE 'held' END AS outcome FROM n WHERE kind = 'lease'""",
)


def _end_of(log):
    """Time of the last row of a log, one value."""
    return F.lit(log.agg(F.max("us")).first()[0])


@query("st4_expired_leases", _LEASES + "SELECT job_id, id, expiry_us AS expired_us FROM e WHERE outcome = 'expired'")
def expired_leases(t):
    return spans.expired_leases(t.lease_events, _end_of(t.lease_events))


@query("st4_lease_ends", _LEASES + "SELECT job_id, id, us, expiry_us, outcome FROM e")
def lease_ends(t):
    return spans.lease_ends(t.lease_events, _end_of(t.lease_events))


@query(
    "st5_online_spans",
    with_tables(
        "node_reports",
        b="""SELECT *, lag(us) OVER (PARTITION BY worker_id ORDER BY us, id) AS before, max(us) OVER () AS as_of FROM node_reports""",
        g=f"""SELECT *, sum(CASE WHEN before IS NULL OR us - before > {HOUR} THEN 1 ELSE 0 END)
                     OVER (PARTITION BY worker_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS span FROM b""",
    )
    + f"""SELECT worker_id, min(us) AS online_us, max(us) AS last_us, count(*) AS reports,
                 CASE WHEN max(us) + {HOUR} < max(as_of) OR span < max(max(span)) OVER (PARTITION BY worker_id) THEN max(us) + {HOUR} END AS offline_us
          FROM g GROUP BY worker_id, span""",
)
def online_spans(t):
    return spans.online_spans(t.node_reports, _end_of(t.node_reports), HOUR)


@query(
    "s8_metric_frame",
    with_tables("nodes")
    + """SELECT CAST(0 AS BIGINT) AS frame, (SELECT strftime(make_timestamp(max(last_seen_us)) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') FROM nodes) AS ts,
                worker_id AS id, role, cpu, memory_mb, pages_per_min, fail_rate, status,
                strftime(make_timestamp(last_seen_us) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS last_seen, last_seen_us
         FROM nodes""",
)
def metric_frame(t):
    """The frame of all nodes, written by the sink and read back from its files."""
    folder = work_folder(t.spark)
    frames.write_frame(tel.node_state(t.node_reports), folder)
    return frames.read_frames(t.spark, folder)
