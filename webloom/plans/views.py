"""Crawl tables bound to the driver's tables, once for Spark and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.clock import micros
from webloom.functions.urls import host_of
from webloom.sources.tables import read_table


class Tables:
    """The given tables of one folder and the crawl tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    @property
    def fetch_log(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("fetch_id"),
            micros(F.col("ts")).alias("us"),
            F.concat(F.lit("d"), (F.col("user_id") % 20).cast("string")).alias("domain"),
            F.concat(F.lit("worker-"), (F.col("user_id") % 4 + 1).cast("string")).alias("worker_id"),
            F.col("user_id").alias("task_id"),
            F.when(F.col("event_type") != "error", 200)
            .when(F.col("event_id") % 3 == 0, 503)
            .when(F.col("event_id") % 3 == 1, 429)
            .otherwise(403)
            .alias("status"),
            (F.col("value") * 10).alias("latency_ms"),
            F.concat(F.lit("proxy-"), (F.col("event_id") % 3 + 1).cast("string")).alias("proxy_url"),
        )

    @property
    def jobs(self) -> DataFrame:
        """Jobs with their lease (every third one is leased) and reclaim count."""
        leases = (
            self.lineitem.filter("l_orderkey % 3 = 0")
            .groupBy(F.col("l_orderkey").alias("id"))
            .agg(F.min(F.floor(micros(F.col("l_shipdate")) / 1_000_000)).alias("lease_expiry"))
        )
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("task_id"),
            (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
            F.floor(micros(F.col("o_orderdate")) / 1_000_000).alias("enqueued_at"),
            (F.col("o_orderkey") % 4).alias("attempt"),
            (F.col("o_orderkey") % 2).alias("reclaims"),
        ).join(leases, "id", "left")

    @property
    def lease_events(self) -> DataFrame:
        """Leases and acknowledgements of jobs: an order is a job, a line a lease of l_quantity days or, if returned, its end."""
        us, days = micros(F.col("l_shipdate")), F.col("l_quantity").cast("bigint")
        acked = F.col("l_returnflag") == "R"
        return self.lineitem.select(
            F.col("l_orderkey").alias("job_id"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            us.alias("us"),
            F.when(acked, "ack").otherwise("lease").alias("kind"),
            F.when(~acked, us + days * 86_400_000_000).alias("expiry_us"),
        )

    @property
    def rules(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("start_url"),
            (F.col("p_size") / 10.0).alias("qps"),
        )

    @property
    def tasks(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("bigint").alias("rule_id"),
            F.expr(
                "CASE c_mktsegment WHEN 'BUILDING' THEN 'created' WHEN 'AUTOMOBILE' THEN 'running' "
                "WHEN 'MACHINERY' THEN 'paused' WHEN 'HOUSEHOLD' THEN 'failed' ELSE 'succeeded' END"
            ).alias("status"),
        )

    @property
    def task_events(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("task_id"),
            micros(F.col("ts")).alias("us"),
            F.col("ts").alias("created_at"),
            F.expr(
                "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'running' "
                "WHEN 'click' THEN 'paused' WHEN 'error' THEN 'failed' ELSE 'succeeded' END"
            ).alias("status"),
        )

    @property
    def audit(self) -> DataFrame:
        return self.events.select(
            F.col("event_id").alias("id"),
            F.expr(
                "CASE event_type WHEN 'signup' THEN 'rule_created' WHEN 'view' THEN 'rule_updated' "
                "WHEN 'error' THEN 'robots_disabled' ELSE 'task_started' END"
            ).alias("action"),
            F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("detail"),
            F.col("ts").alias("created_at"),
        )

    @property
    def crawl_results(self) -> DataFrame:
        return self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.col("l_suppkey").alias("task_id"),
            F.concat(F.lit("http://shop.example/p/"), F.col("l_partkey").cast("string")).alias("url"),
            F.col("l_linenumber"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_extendedprice").alias("price"),
        )

    @property
    def node_reports(self) -> DataFrame:
        return self.events.select(
            F.concat(F.lit("worker-"), (F.col("user_id") % 40 + 1).cast("string")).alias("worker_id"),
            micros(F.col("ts")).alias("us"),
            F.col("event_id").alias("id"),
            F.when(F.col("event_type").isin("view", "click"), "metrics").otherwise("heartbeat").alias("kind"),
            F.when(F.col("event_type") == "signup", "").otherwise("worker").alias("role"),
            F.when(F.col("event_type") == "error", "degraded")
            .when(F.col("event_type") == "purchase", "online")
            .otherwise("")
            .alias("status"),
            F.col("value").alias("cpu"),
            (F.col("value") * 2).alias("memory_mb"),
            (F.col("value") * 3).alias("pages_per_min"),
            (F.col("value") / 1000).alias("fail_rate"),
        )

    @property
    def edges(self) -> DataFrame:
        order, part, supp = (
            F.concat(F.lit(p), F.col(c).cast("string"))
            for p, c in (("o", "l_orderkey"), ("p", "l_partkey"), ("s", "l_suppkey"))
        )
        both = self.lineitem.select(order.alias("src"), part.alias("dst")).union(self.lineitem.select(part.alias("src"), supp.alias("dst")))
        return both.repartition("src").distinct()  # moved once, also when they are kept by src

    @property
    def robots(self) -> DataFrame:
        """A robots file per host: a group for everyone, one for another crawler, comments."""
        delay = (F.length("host") % 3).cast("string")
        return self.pages.select(host_of(F.col("url")).alias("host")).distinct().select(
            "host",
            F.concat(
                F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUSER-AGENT: *\nDisallow: /en/ # closed\nAllow: /en/5\n"
                      "Disallow:\ndisallow: /fr/1\nAllow: /fr/1\nCrawl-delay: "),
                delay,
                F.lit("\nnonsense\n"),
            ).alias("body"),
        )


# The same tables as common table expressions of the oracle.
CTE = {
    "fetch_log": """
        SELECT event_id AS fetch_id, epoch_us(ts) AS us, 'd' || CAST(user_id % 20 AS VARCHAR) AS domain,
               'worker-' || CAST(user_id % 4 + 1 AS VARCHAR) AS worker_id, user_id AS task_id,
               CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 503
                    WHEN event_id % 3 = 1 THEN 429 ELSE 403 END AS status,
               value * 10 AS latency_ms, 'proxy-' || CAST(event_id % 3 + 1 AS VARCHAR) AS proxy_url
        FROM events""",
    "leases": """
        SELECT l_orderkey AS id, CAST(floor(epoch(min(l_shipdate))) AS BIGINT) AS lease_expiry FROM lineitem
        WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey""",
    "jobs": """
        SELECT o_orderkey AS id, o_custkey AS task_id,
               6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
               CAST(floor(epoch(o_orderdate)) AS BIGINT) AS enqueued_at, o_orderkey % 4 AS attempt, o_orderkey % 2 AS reclaims,
               lease_expiry
        FROM orders LEFT JOIN leases ON leases.id = orders.o_orderkey""",
    "lease_events": """
        SELECT l_orderkey AS job_id, l_orderkey * 10 + l_linenumber AS id, epoch_us(l_shipdate) AS us,
               CASE WHEN l_returnflag = 'R' THEN 'ack' ELSE 'lease' END AS kind,
               CASE WHEN l_returnflag <> 'R' THEN epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 86400000000 END AS expiry_us
        FROM lineitem""",
    "rules": """
        SELECT p_partkey AS id, p_name AS name, p_brand AS start_url, p_size / 10.0 AS qps FROM part""",
    "tasks": """
        SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS rule_id,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'created' WHEN 'AUTOMOBILE' THEN 'running'
                    WHEN 'MACHINERY' THEN 'paused' WHEN 'HOUSEHOLD' THEN 'failed' ELSE 'succeeded' END AS status
        FROM customer""",
    "task_events": """
        SELECT event_id AS id, user_id AS task_id, epoch_us(ts) AS us, ts AS created_at,
               CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'running'
                    WHEN 'click' THEN 'paused' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status
        FROM events""",
    "audit": """
        SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'rule_created' WHEN 'view' THEN 'rule_updated'
                    WHEN 'error' THEN 'robots_disabled' ELSE 'task_started' END AS action,
               'user ' || CAST(user_id AS VARCHAR) AS detail, ts AS created_at
        FROM events""",
    "crawl_results": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS task_id,
               'http://shop.example/p/' || CAST(l_partkey AS VARCHAR) AS url, l_linenumber,
               l_shipdate AS created_at, l_extendedprice AS price FROM lineitem""",
    "node_reports": """
        SELECT 'worker-' || CAST(user_id % 40 + 1 AS VARCHAR) AS worker_id, epoch_us(ts) AS us, event_id AS id,
               CASE WHEN event_type IN ('view', 'click') THEN 'metrics' ELSE 'heartbeat' END AS kind,
               CASE WHEN event_type = 'signup' THEN '' ELSE 'worker' END AS role,
               CASE event_type WHEN 'error' THEN 'degraded' WHEN 'purchase' THEN 'online' ELSE '' END AS status,
               value AS cpu, value * 2 AS memory_mb, value * 3 AS pages_per_min, value / 1000 AS fail_rate
        FROM events""",
    "nodes": """
        SELECT worker_id, arg_max(CASE WHEN role = '' THEN 'worker' ELSE role END, us) AS role,
               arg_max(CASE WHEN status = '' THEN 'online' ELSE status END, us) AS status, max(us) AS last_seen_us,
               coalesce(arg_max(cpu, us) FILTER (WHERE kind = 'metrics'), 0) AS cpu,
               coalesce(arg_max(memory_mb, us) FILTER (WHERE kind = 'metrics'), 0) AS memory_mb,
               coalesce(arg_max(pages_per_min, us) FILTER (WHERE kind = 'metrics'), 0) AS pages_per_min,
               coalesce(arg_max(fail_rate, us) FILTER (WHERE kind = 'metrics'), 0) AS fail_rate
        FROM node_reports GROUP BY worker_id""",
    "edges": """
        SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem
        UNION SELECT 'p' || CAST(l_partkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem""",
    # Pages taken apart: host, canonical URL, navigation hrefs, article source and its text.
    "page_parts": """
        SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
               regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
               regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path,
               regexp_replace(url, '#.*$', '') AS canonical,
               regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs,
               regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article,
               replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;?', '&', 'g'), '&quot;', '"') AS h1
        FROM pages""",
    # Links of a page: hrefs are '/word'; path characters outside the plain set are percent-encoded.
    "page_links": """
        SELECT DISTINCT page_id, url, host, site || replace(replace(replace(replace(replace(replace(replace(replace(
                   replace(url_encode(replace(href, '&amp;', '&')), '%2F', '/'), '%2C', ','), '%24', '$'), '%26', '&'),
                   '%2B', '+'), '%3A', ':'), '%3B', ';'), '%3D', '='), '%40', '@') AS link
        FROM (SELECT page_id, url, host, site, unnest(hrefs) AS href FROM page_parts)""",
    "robots_rows": """
        SELECT DISTINCT host, kind, prefix, CAST(length(host) % 3 AS DOUBLE) AS delay
        FROM page_parts, (VALUES ('disallow', '/en/'), ('allow', '/en/5'), ('disallow', ''),
                                 ('disallow', '/fr/1'), ('allow', '/fr/1')) AS r(kind, prefix)""",
    "url_allowed": """
        SELECT page_id, p.host, path,
               coalesce(max(length(prefix)) FILTER (WHERE kind = 'disallow' AND prefix <> ''
                            AND starts_with(path, prefix)), 0) AS no,
               coalesce(max(length(prefix)) FILTER (WHERE kind = 'allow' AND starts_with(path, prefix)), 0) AS yes
        FROM page_parts p JOIN robots_rows r ON p.host = r.host GROUP BY page_id, p.host, path""",
}
_NEEDS = {
    "jobs": ["leases"],
    "nodes": ["node_reports"],
    "page_links": ["page_parts"],
    "robots_rows": ["page_parts"],
    "url_allowed": ["page_parts", "robots_rows"],
}


def with_tables(*names: str, recursive: bool = False, **more: str) -> str:
    """The WITH clause of an oracle query: named tables, what they need, and extra ones."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTE[n]})" for n in ordered] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"
