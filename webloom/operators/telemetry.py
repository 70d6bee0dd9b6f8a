"""Crawl telemetry: counters, throughput and failure windows, adaptive rates, proxies, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import blocked, failed, round_half_up
from webloom.operators.ordered import (
    composed_clamps,
    failure_runs,
    largest_key,
    next_value,
    previous_row,
    running_count,
    running_max_before,
    trailing_sums,
)
from webloom.session import cut_lineage

SECOND = 1_000_000
# Counters a task keeps.
COUNTERS = ("enqueued", "duplicated", "crawled", "failed", "results", "robots_skip")


# Counters -------------------------------------------------------------------------------------


def fetch_sums(status: Column, robots_skip: Column, results: Column, counted: Column | None = None) -> dict[str, Column]:
    """Aggregates of the fetch counters. A transport error (status NULL) counts as failed only, a bad
    status as failed and crawled."""
    counted = F.lit(True) if counted is None else counted
    got = counted & status.isNotNull() & ~robots_skip
    bad = got & failed(status)
    lost = counted & status.isNull() & ~robots_skip
    return {
        "crawled": F.count_if(got),
        "failed": F.count_if(bad | lost),
        "results": F.sum(F.when(got & ~bad, results).otherwise(0)).cast("bigint"),
        "robots_skip": F.count_if(counted & robots_skip),
    }


def task_counters(fetches: DataFrame) -> DataFrame:
    """Per-task counters from fetch outcomes (A1): task_id, status, robots_skip, results."""
    sums = fetch_sums(F.col("status"), F.col("robots_skip"), F.col("results"))
    return fetches.groupBy("task_id").agg(*[v.alias(k) for k, v in sums.items()])


def stats_map(counters: DataFrame) -> DataFrame:
    """Counters of a task as one MAP<STRING,BIGINT>, absent and zero ones left out."""
    have = [c for c in COUNTERS if c in counters.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("bigint").alias("value")) for c in have])
    return counters.select("task_id", F.map_from_entries(F.filter(pairs, lambda p: p["value"] != 0)).alias("stats"))


def cluster_totals(nodes: DataFrame) -> DataFrame:
    """Sum of pages per minute and plain mean of fail rates over all nodes (A2)."""
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.coalesce(F.sum("pages_per_min"), F.lit(0.0)).alias("pages_per_min"),
        F.coalesce(F.avg("fail_rate"), F.lit(0.0)).alias("fail_rate"),
    )


def worker_totals(hits: DataFrame, started_us: Column, as_of_us: Column) -> DataFrame:
    """Lifetime pages, fails and pages per minute of each worker."""
    minutes = F.when(as_of_us > started_us, (as_of_us - started_us) / F.lit(60.0 * SECOND)).otherwise(F.lit(1 / 60))
    return hits.groupBy("worker_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(failed(F.col("status"))).alias("fails"),
        (F.count(F.lit(1)) / F.max(minutes)).alias("pages_per_min"),
    )


# Windows --------------------------------------------------------------------------------------


def recent_throughput(hits: DataFrame, as_of_us: int, width_us: int = 60 * SECOND) -> DataFrame:
    """Pages, fails and fail rate of each worker over the last minute before ``as_of``."""
    last = hits.filter((F.col("us") > as_of_us - width_us) & (F.col("us") <= as_of_us))
    pages, fails = F.count(F.lit(1)), F.count_if(failed(F.col("status")))
    return last.groupBy("worker_id").agg(
        pages.alias("pages"), fails.alias("fails"), round_half_up(fails / pages, 3).alias("fail_rate")
    )


def throughput_trace(hits: DataFrame, width_us: int = 60 * SECOND, keys: tuple[str, ...] = ("worker_id",)) -> DataFrame:
    """Pages and fail rate of the trailing minute at every page."""
    sums = {"pages": F.lit(1), "fails": F.when(failed(F.col("status")), 1).otherwise(0)}
    out = trailing_sums(hits, list(keys), "us", width_us, sums)
    return out.withColumn("fail_rate", round_half_up(F.col("fails") / F.col("pages"), 3))


def block_trace(log: DataFrame, width_us: int = 30 * SECOND) -> DataFrame:
    """Blocked share and mean latency of the trailing 30 s per domain at every fetch."""
    sums = {
        "total": F.lit(1),
        "blocked": F.when(blocked(F.col("status")), 1).otherwise(0),
        "latency_us": F.coalesce(F.round(F.col("latency_ms") * 1000), F.lit(0)),
    }
    out = trailing_sums(log, ["domain"], "us", width_us, sums)
    return out.withColumn("ratio", F.col("blocked") / F.col("total")).withColumn(
        "avg_ms", F.col("latency_us") / F.col("total") / 1000
    )


def rate_factor(ratio: Column, avg_ms: Column) -> Column:
    """How a domain's rate moves after a fetch."""
    return (
        F.when(ratio >= 0.2, 0.5)
        .when(ratio >= 0.05, 0.75)
        .when(avg_ms > 1500, 0.85)
        .when((ratio == 0) & (avg_ms < 400), 1.08)
        .otherwise(1.0)
    )


MIN_QPS = 0.2


def adaptive_trace(log: DataFrame, width_us: int = 30 * SECOND, block: int | None = None) -> DataFrame:
    """Rate of each domain after every fetch (W4). ``log`` carries base_qps next to the W1 columns.

    A step maps the rate x to min(base, max(0.2, x * factor)); the first one starts from the domain's base rate and
    leaves one value only. Steps compose to maps of the same shape, so all rates come from a parallel prefix over
    the steps of a domain. Fetches without a domain belong to the domain ``default``.
    """
    log = log.withColumn("domain", F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("default")))
    base = F.when(F.col("base_qps") > 0, F.col("base_qps")).otherwise(F.lit(2.0))
    steps = (
        block_trace(log, width_us)
        .withColumn("factor", rate_factor(F.col("ratio"), F.col("avg_ms")))
        .select("domain", "us", "fetch_id", F.col("factor").cast("double").alias("factor"), base.cast("double").alias("hi"))
    )
    steps = cut_lineage(steps)
    placed = running_count(steps, ["domain"], ["us", "fetch_id"], "_i")
    start = F.least(F.col("hi"), F.greatest(F.lit(MIN_QPS), F.col("hi") * F.col("factor")))
    first = F.col("_i") == 1
    maps = placed.withColumn("m", F.when(first, 1.0).otherwise(F.col("factor"))).withColumn("lo", F.when(first, start).otherwise(F.lit(MIN_QPS)))
    maps = maps.withColumn("hi", F.when(first, start).otherwise(F.col("hi")))
    out = composed_clamps(maps.select("domain", "us", "fetch_id", "factor", "_i", "m", "lo", "hi"), ["domain"], "_i", largest_key(steps, ["domain"]), block)
    return out.select("domain", "fetch_id", "us", "factor", F.col("lo").alias("qps"))


def recent_points(series: DataFrame, keys: list[str], order: list[str], n: int = 60) -> DataFrame:
    """The newest n points of each series (W3); a ring asked for fewer than 8 keeps 60."""
    n = 60 if n < 8 else n
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    # Row-number filters are limited before the shuffle, so a long series sends n rows per task.
    return series.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def recent_cluster_points(frames: DataFrame, n: int = 40) -> DataFrame:
    """The newest n points of one cluster-wide series (W3): a global top-n, no window."""
    return frames.orderBy(F.desc("frame_us")).limit(n)


# Rates ----------------------------------------------------------------------------------------


def admit_times(requests: DataFrame) -> DataFrame:
    """When a token bucket admits each request of a domain.

    ``requests``: domain, us, id, qps (one value per domain). The bucket starts with qps tokens at
    the first request, holds 2*qps and refills qps per second. In closed form, with t the arrivals in
    seconds since the first one: request i leaves at max(t_i, (i-1)/q + max(1, M) - 2 + 1/q), where M
    is the largest t_j - (j-1)/q of the requests before it. Below 0.5 qps a full bucket never holds a
    whole token and nothing is admitted.
    """
    first = requests.groupBy("domain").agg(F.min("us").alias("_t0"))
    timed = running_count(requests, ["domain"], ["us", "id"], "_i").join(first, "domain")
    sec = (F.col("us") - F.col("_t0")) / F.lit(float(SECOND))
    timed = timed.withColumn("_sec", sec).withColumn("_slack", sec - (F.col("_i") - 1) / F.col("qps"))
    timed = running_max_before(timed, ["domain"], ["us", "id"], "_slack", "_m")
    ahead = F.greatest(F.lit(1.0), F.col("_m"))
    earliest = (F.col("_i") - 1) / F.col("qps") + ahead - 2 + F.lit(1.0) / F.col("qps")
    admit = F.when(F.col("qps") >= 0.5, F.greatest(F.col("_sec"), earliest))
    return timed.select(*requests.columns, (admit - F.col("_sec")).alias("wait_s"), admit.alias("admit_s"))


def burst_plan(requests: DataFrame, order: list[str], chunk: Column | None = None) -> DataFrame:
    """Admit time of each request when all arrive at once: max(0, (i - qps) / qps)."""
    placed = running_count(requests, ["domain"], order, "i", chunk)
    return placed.withColumn("admit_s", F.greatest(F.lit(0.0), (F.col("i") - F.col("qps")) / F.col("qps")))


def rate_audit(log: DataFrame, qps: Column, band: float = 0.1) -> DataFrame:
    """Observed requests per second of each domain against its configured rate."""
    span = (F.max("us") - F.min("us")) / F.lit(float(SECOND))
    seen = log.groupBy("domain").agg(
        F.count(F.lit(1)).alias("requests"), span.alias("span_s"), F.max(qps).alias("qps")
    )
    rate = F.when(F.col("span_s") > 0, (F.col("requests") - 1) / F.col("span_s"))
    return seen.withColumn("observed_qps", rate).withColumn(
        "within", F.coalesce(rate.between(F.col("qps") * (1 - band), F.col("qps") * (1 + band)), F.lit(False))
    )


def cpu_percent(samples: DataFrame, rows: int | None = None) -> DataFrame:
    """CPU share between two readings of a usage counter, within 0..400."""
    both = previous_row(samples, ["worker_id"], ["us", "id"], {"_u0": "usec", "_t0": "us"}, rows=rows)
    pct = (F.col("usec") - F.col("_u0")) / (F.col("us") - F.col("_t0")) * 100.0
    # An unsigned counter that runs backwards wraps to a huge difference, which the clamp cuts.
    usable = (F.col("_u0") != 0) & (F.col("us") > F.col("_t0"))
    value = F.when(F.col("usec") < F.col("_u0"), 400.0).otherwise(F.least(F.lit(400.0), pct))
    return both.select(*samples.columns, F.when(usable, value).otherwise(0.0).alias("cpu"))


# Proxies --------------------------------------------------------------------------------------


def proxy_ok(status: Column) -> Column:
    """A reply counts against the proxy from 500 on, and on 407; so does no reply at all."""
    return F.coalesce((status < 500) & (status != 407), F.lit(False))


def proxy_runs(log: DataFrame, rows: int | None = None) -> DataFrame:
    """Consecutive failures of a proxy after each report."""
    return failure_runs(log, ["proxy_url"], ["us", "fetch_id"], proxy_ok(F.col("status")), "consec", rows=rows)


def proxy_evictions(runs: DataFrame, limit: int = 3) -> DataFrame:
    """First report at which a proxy reached the failure limit."""
    hit = runs.filter(F.col("consec") == limit)
    return hit.groupBy("proxy_url").agg(F.min(F.struct("us", "fetch_id")).alias("_f")).select(
        "proxy_url", F.col("_f.us").alias("evicted_us"), F.col("_f.fetch_id").alias("fetch_id")
    )


_AT = ("us", "fetch_id")


def pool_revivals(runs: DataFrame, limit: int = 3, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """When the pool was revived: (revivals, spans) with spans = the ``limit`` failures in a row that evict a proxy.

    A proxy is evicted by ``limit`` failures in a row since the last revival, and the pool is revived when its last
    proxy is evicted. So the revival after a time T is the latest, over all proxies, of the first spans that begin after
    T. That is worked out for the end of every span at once, which gives each possible revival its successor; the
    revivals that did happen are those reached from the first one, found by doubling the steps.
    """
    order = F.struct(*_AT)
    begin = previous_starts(runs, limit, rows)
    spans = cut_lineage(begin.filter(F.col("consec") >= limit).select("proxy_url", F.col("_start.us").alias("us"), F.col("_start.fetch_id").alias("fetch_id"), order.alias("ends")))
    pool = [r["proxy_url"] for r in runs.select("proxy_url").distinct().collect()]  # the proxies of one pool
    # Every end of a span asks each proxy; at one place in the log the question stands behind the span that begins there.
    asked = spans.select(F.col("ends").alias("t")).distinct().select(F.explode(F.array(*[F.lit(p) for p in pool]).cast("array<string>")).alias("proxy_url"), "t")
    none = F.lit(None).cast(asked.schema["t"].dataType)
    both = spans.select("proxy_url", *_AT, F.lit(0).alias("ask"), "ends", none.alias("t")).unionByName(
        asked.select("proxy_url", "t.us", "t.fetch_id", F.lit(1).alias("ask"), none.alias("ends"), "t")
    )
    answers = next_value(both, ["proxy_url"], [*_AT, "ask"], "ends", "first", rows).filter("ask = 1")

    def latest(df: DataFrame) -> DataFrame:
        return df.groupBy("t").agg(F.max("first").alias("next"), F.count("first").alias("_n")).filter(F.col("_n") == len(pool)).select("t", "next")

    step = cut_lineage(latest(answers))
    start = spans.groupBy("proxy_url").agg(F.min("ends").alias("first")).withColumn("t", F.lit(0))
    reached = cut_lineage(latest(start).select(F.col("next").alias("t")))
    while True:
        more = reached.join(step, "t").select(F.col("next").alias("t"))
        wider = cut_lineage(reached.union(more).distinct())
        if wider.count() == reached.count():
            return reached, spans
        reached = wider
        step = cut_lineage(step.join(step.select(F.col("t").alias("next"), F.col("next").alias("then")), "next").select("t", F.col("then").alias("next")))


def previous_starts(runs: DataFrame, limit: int, rows: int | None = None) -> DataFrame:
    """Adds ``_start``: us and fetch_id of the report ``limit`` - 1 reports of the proxy before."""
    out = runs.withColumn("_start", F.struct(*_AT))
    for _ in range(limit - 1):
        out = previous_row(out, ["proxy_url"], list(_AT), {"_before_start": "_start"}, rows=rows)
        out = out.withColumn("_start", F.col("_before_start")).drop("_before_start")
    return out


def proxy_totals(log: DataFrame, limit: int = 3, rows: int | None = None) -> DataFrame:
    """Hits, fails, evictions and health of each proxy (A5); fetches without a proxy count for none.

    An evicted proxy is healthy again once the pool is revived. A pool whose last proxy is evicted counts as revived,
    as the next fetch does that first.
    """
    runs = cut_lineage(proxy_runs(log.filter(F.col("proxy_url").isNotNull()).select("proxy_url", "status", *_AT), rows))
    revivals, spans = pool_revivals(runs, limit, rows)
    last = revivals.agg(F.count("*").alias("rounds"), F.max("t").alias("t")).first()
    if last["t"] is not None:
        us, fetch = F.lit(last["t"]["us"]), F.lit(last["t"]["fetch_id"])
        spans = spans.filter((F.col("us") > us) | ((F.col("us") == us) & (F.col("fetch_id") > fetch)))
    out_now = spans.select("proxy_url").distinct().withColumn("out", F.lit(True))
    totals = runs.groupBy("proxy_url").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(~proxy_ok(F.col("status"))).alias("fails"), F.max("consec").alias("longest_run")
    )
    gone = F.coalesce("out", F.lit(False))
    return totals.join(out_now, "proxy_url", "left").select(
        "proxy_url", "hits", "fails", "longest_run", (F.lit(last["rounds"]) + gone.cast("bigint")).alias("evictions"), (~gone).alias("healthy")
    )


def pool_totals(proxies: DataFrame) -> DataFrame:
    """Pool-wide hits, fails, evictions and healthy count (A5)."""
    return proxies.agg(
        F.count(F.lit(1)).alias("size"),
        F.sum("hits").alias("hits"),
        F.sum("fails").alias("fails"),
        F.sum("evictions").alias("evictions"),
        F.count_if("healthy").alias("healthy"),
    )


def round_robin(
    requests: DataFrame, pool: list[str], order: list[str], proxies: Column, chunk: Column | None = None
) -> DataFrame:
    """Proxy of each request when the alive set is fixed (W6): position modulo pool size."""
    placed = running_count(requests, pool, order, "_i", chunk)
    at = ((F.col("_i") - 1) % F.size(proxies)).cast("int")
    return placed.withColumn("assigned", F.get(proxies, at)).drop("_i")


def shared_hits(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Proxy rows with the larger of the local and the shared hit counter."""
    remote = shared.select("proxy_url", F.col("hits").alias("_shared"))
    return local.join(remote, "proxy_url", "left").withColumn(
        "hits", F.greatest("hits", F.coalesce("_shared", F.lit(0).cast("bigint")))
    ).drop("_shared")


# Nodes ----------------------------------------------------------------------------------------


def node_state(reports: DataFrame) -> DataFrame:
    """Current state of each worker from mixed reports (S6, ST6).

    A metrics report sets every column; a heartbeat sets role, status and last_seen only. Blank role
    and status mean 'worker' and 'online'.
    """
    at = F.struct("us", "id")
    metrics = F.col("kind") == "metrics"
    filled = reports.select(
        "worker_id", "us", "id", "kind", "cpu", "memory_mb", "pages_per_min", "fail_rate",
        F.coalesce(F.nullif("role", F.lit("")), F.lit("worker")).alias("role"),
        F.coalesce(F.nullif("status", F.lit("")), F.lit("online")).alias("status"),
    )

    def latest(c: str) -> Column:
        return F.coalesce(F.max_by(F.col(c), F.when(metrics, at)), F.lit(0.0)).alias(c)

    return filled.groupBy("worker_id").agg(
        F.max_by("role", at).alias("role"),
        F.max_by("status", at).alias("status"),
        F.max("us").alias("last_seen_us"),
        *[latest(c) for c in ("cpu", "memory_mb", "pages_per_min", "fail_rate")],
    )


def mark_stale(nodes: DataFrame, as_of_us: Column, after_us: int = 20 * SECOND) -> DataFrame:
    """Nodes not heard of for 20 s become offline."""
    stale = F.col("last_seen_us") < as_of_us - F.lit(after_us)
    return nodes.withColumn("status", F.when(stale, "offline").otherwise(F.col("status")))


def unexpired(df: DataFrame, created_us: str, as_of_us: Column, ttl_us: int) -> DataFrame:
    """Entries younger than their time to live (P14): 30 min snapshots, 10 min robots files."""
    return df.filter(as_of_us - F.col(created_us) <= ttl_us)


def compliance_changes(versions: DataFrame) -> DataFrame:
    """Rule versions that switch robots respect off; new rules start from 'on' (W13)."""
    both = previous_row(versions, ["id"], ["version"], {"_was": "respect_robots"})
    off = F.coalesce(F.col("_was"), F.lit(True)) & ~F.col("respect_robots")
    return both.filter(off).select("id", "version", F.lit("robots_disabled").alias("action"))
