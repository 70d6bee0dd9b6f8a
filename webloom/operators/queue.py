"""Batch forms of the job queue: order, take, acknowledge, reclaim, drop, lookups, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import canonical_url

MAX_LEASE_SECONDS = 30
CHILD_PRIORITY = 5


def job_order() -> list[Column]:
    """By a score of priority, time and attempt, then id.

    The score is a DOUBLE: beside a priority it has no room for thousandths, so attempts then leave the
    order to the id; only at priority 0 do they count.
    """
    score = -F.col("priority").cast("double") * F.lit(1e13) + F.col("enqueued_at").cast("double") + F.col("attempt") * F.lit(1e-3)
    return [score.asc(), F.asc("id")]


def in_job_order(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(*job_order())


def take_next(ready: DataFrame, n: int, owner: str, now_s: int, ttl_s: int = MAX_LEASE_SECONDS) -> DataFrame:
    """The next n ready jobs, leased to a worker for at most 30 s (T3); planned as a top-k."""
    ttl = MAX_LEASE_SECONDS if not 0 < ttl_s <= MAX_LEASE_SECONDS else ttl_s
    return in_job_order(ready).limit(n).withColumns(
        {"owner": F.lit(owner), "lease_expiry": F.lit(now_s + ttl).cast("bigint")}
    )


def acknowledge(jobs: DataFrame, acked: DataFrame) -> DataFrame:
    """Jobs without the finished ones."""
    return jobs.join(acked.select("id"), "id", "left_anti")


def reclaim(jobs: DataFrame, now_s: Column, keep_priority: bool = False) -> DataFrame:
    """Ready jobs plus those whose lease ran out (U4).

    A reclaimed job ranks as priority 0 from now on, as the original does; ``keep_priority`` keeps
    its own. Ready jobs have no lease. One pass: the union is a filter on the lease column.
    """
    expired = F.col("lease_expiry") <= now_s
    out = jobs.filter(F.col("lease_expiry").isNull() | expired)
    flagged = out.withColumn("reclaimed", F.coalesce(expired, F.lit(False)))
    if not keep_priority:
        flagged = flagged.withColumns(
            {
                "priority": F.when(F.col("reclaimed"), 0).otherwise(F.col("priority")),
                "enqueued_at": F.when(F.col("reclaimed"), now_s).otherwise(F.col("enqueued_at")),
            }
        )
    return flagged.withColumn("lease_expiry", F.when(~F.col("reclaimed"), F.col("lease_expiry")))


def drop_tasks(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Jobs without those of cancelled tasks."""
    return jobs.join(cancelled.select("task_id").distinct(), "task_id", "left_anti")


def dropped_counts(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """How many jobs each cancelled task loses."""
    hit = jobs.join(cancelled.select("task_id").distinct(), "task_id", "left_semi")
    return hit.groupBy("task_id").agg(F.count(F.lit(1)).alias("dropped"))


def queue_stats(jobs: DataFrame) -> DataFrame:
    """Ready and leased counts and the number of reclaims (A3)."""
    return jobs.agg(
        F.count_if(F.col("lease_expiry").isNull()).alias("ready"),
        F.count_if(F.col("lease_expiry").isNotNull()).alias("leased"),
        F.coalesce(F.sum("reclaims"), F.lit(0)).cast("bigint").alias("reclaim_total"),
    )


def pending_per_task(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("task_id").agg(F.count(F.lit(1)).alias("pending"))


def idle_tasks(tasks: DataFrame, jobs: DataFrame, stats: DataFrame) -> DataFrame:
    """Running tasks without a pending job that have made progress: they are finished."""
    progress = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("crawled", "failed", "robots_skip")), F.lit(0))
    running = tasks.filter(F.col("status") == "running")
    # Distinct ids first: the anti join then sees each busy task once, however many jobs it has.
    busy = jobs.select("task_id").distinct()
    return running.join(busy, "task_id", "left_anti").join(stats, "task_id").filter(progress > 0)


def job_lookup(jobs: DataFrame, tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Jobs with the task and the rule they name; what is missing stays NULL.

    Both lookups are many-to-one on the small side's key. No hint is set: below the broadcast
    threshold Spark copies the lookup table, beyond it a hot task is split by the skew join.
    """
    t = tasks.select("task_id", F.col("status").alias("task_status"), "max_depth")
    r = rules.select("rule_id", F.col("qps").alias("rule_qps"), "respect_robots")
    return jobs.join(t, "task_id", "left").join(r, "rule_id", "left")


def missing_references(jobs: DataFrame, tasks: DataFrame, rules: DataFrame) -> DataFrame:
    """Jobs that fail because their task or rule is gone."""
    no_task = jobs.join(tasks.select("task_id"), "task_id", "left_anti").withColumn("missing", F.lit("task"))
    with_task = jobs.join(tasks.select("task_id"), "task_id", "left_semi")
    no_rule = with_task.join(rules.select("rule_id"), "rule_id", "left_anti").withColumn("missing", F.lit("rule"))
    return no_task.unionByName(no_rule)


def seed_jobs(tasks: DataFrame) -> DataFrame:
    """Depth-0 jobs of a task: priority 10 for the first seed, one less for each further one."""
    return (
        tasks.select("task_id", "rule_id", F.posexplode("seed_urls").alias("_pos", "_raw"))
        .select(
            "task_id",
            "rule_id",
            canonical_url(F.col("_raw")).alias("url"),
            F.lit(0).alias("depth"),
            (F.lit(10) - F.col("_pos")).alias("priority"),
        )
        .filter(F.col("url") != "")
    )
