"""Replay of one crawl step over a batch of jobs.

Jobs meet their task and rule, tasks that are not running and URLs closed by robots fall out, failed
fetches are counted, the rest is extracted; results, counters and child jobs come out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.selectors import rule_plan
from webloom.functions.text import failed
from webloom.operators.extract import extract, result_rows, with_dom
from webloom.operators.queue import CHILD_PRIORITY
from webloom.operators.robots import check_robots
from webloom.operators.telemetry import fetch_sums


@dataclass(frozen=True)
class CrawlStep:
    """Frames of one step. ``fetched`` is the parsed batch, one row per job; the others select from it.

    A job that writes several of them should write ``fetched`` once and build the step from the table.
    """

    fetched: DataFrame

    @property
    def results(self) -> DataFrame:
        """Rows for the results table."""
        return result_rows(self.fetched, F.col("task_id"))

    @property
    def offers(self) -> DataFrame:
        """Links to follow, as child jobs one level deeper."""
        return self.fetched.select(
            "task_id",
            "rule_id",
            F.explode("links").alias("url"),
            (F.col("depth") + 1).alias("depth"),
            F.lit(CHILD_PRIORITY).alias("priority"),
        )

    def counters(self, seen: DataFrame) -> DataFrame:
        """All six counters per task (A1); ``seen`` are the URLs the tasks knew before.

        One pass: a page becomes one row for itself (URL NULL) and one per link, and both kinds are
        summed per (task, URL) before the known URLs are joined.
        """
        page = F.col("_link").isNull()
        rows = self.fetched.select(
            "task_id", "status", "robots_skip", F.size("items").alias("results"),
            F.explode(F.array_prepend("links", F.lit(None))).alias("_link"),
        )
        sums = fetch_sums(F.col("status"), F.col("robots_skip"), F.col("results"), page)
        per_url = rows.groupBy("task_id", F.col("_link").alias("url")).agg(
            *[v.alias(k) for k, v in sums.items()], F.count(F.lit(1)).alias("_n")
        )
        known = seen.select("task_id", "url", F.lit(True).alias("_known")).distinct()
        link = F.col("url").isNotNull()
        enqueued = F.count_if(link & F.col("_known").isNull())
        offered = F.sum(F.when(link, F.col("_n")).otherwise(0))
        return (
            per_url.join(known, ["task_id", "url"], "left")
            .groupBy("task_id")
            .agg(
                *[F.sum(k).cast("bigint").alias(k) for k in sums],
                enqueued.alias("enqueued"),
                (offered - enqueued).alias("duplicated"),
            )
        )


def crawl_step(
    jobs: DataFrame, tasks: DataFrame, rules: DataFrame, pages: DataFrame, robots: DataFrame, with_html: bool = True,
    fetch: tuple[str, ...] = ("url",),
) -> CrawlStep:
    """``jobs``: task_id, rule_id, url, depth; ``pages``: url, html, status (the fetch outcome), one row
    per fetch; a job without a row got no reply. ``fetch`` are the columns by which a job meets its page: the URL, and
    more where a URL is fetched several times."""
    plans = rules.select(
        "rule_id",
        "respect_robots",
        rule_plan(F.col("item_selector"), F.col("link_selector"), F.col("fields")).alias("plan"),
    )
    running = tasks.filter(F.col("status") == "running").select("task_id", "max_depth")
    live = jobs.join(running, "task_id").join(plans, "rule_id", "left")
    checked = check_robots(live, robots).withColumn(
        "robots_skip", F.coalesce(F.col("respect_robots") & ~F.col("allowed"), F.lit(False))
    )
    # Only bodies of the batch's URLs and of good replies travel to the join: the semi join comes first, and
    # Spark sends a small batch to the pages. Meeting bodies by URL spreads a hot task or rule before parsing.
    fine = F.col("status").isNotNull() & ~failed(F.col("status"))
    by = list(fetch)
    bodies = pages.select(*by, "status", F.when(fine, F.col("html")).alias("html"))
    fetched = checked.join(bodies.join(jobs.select(*by), by, "left_semi"), by, "left")
    # A job whose rule is gone fails without a fetch, like one whose fetch got no reply.
    fetched = fetched.withColumn("status", F.when(F.col("plan").isNotNull(), F.col("status")))
    good = ~F.col("robots_skip") & F.coalesce(fine, F.lit(False))
    shredded = with_dom(fetched.withColumn("html", F.when(good, F.col("html"))), with_html)
    extracted = extract(shredded, F.col("plan"))
    none_items = F.array().cast("array<map<string,string>>")
    none_links = F.array().cast("array<string>")
    fetched = extracted.select(
        "task_id", "rule_id", "url", "depth", "max_depth", "status", "robots_skip",
        F.when(good, F.col("items")).otherwise(none_items).alias("items"),
        F.when(good & (F.col("depth") < F.col("max_depth")), F.col("links")).otherwise(none_links).alias("links"),
    )
    return CrawlStep(fetched)
