"""Event-time streaming forms. Each function takes a batch frame as well, which is how it is checked.

The original works on processing time; here the event time ``ts`` decides and a watermark bounds how
late a row may come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions.text import failed, round_half_up
from webloom.operators.telemetry import SECOND, node_state, task_counters

LATE = "30 seconds"


def sliding_throughput(
    hits: DataFrame, width: str = "60 seconds", slide: str = "2 seconds", late: str = LATE
) -> DataFrame:
    """Pages and fail rate per worker in sliding windows (ST1).

    Hits are first summed into slots of one slide, so a hit is not copied into every window it
    belongs to: only slots are, after the first aggregation has shrunk them.
    """
    slot = F.window("ts", slide)
    slots = (
        hits.withWatermark("ts", late)
        .groupBy("worker_id", slot.alias("slot"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(failed(F.col("status"))).alias("bad"))
    )
    sums = slots.groupBy("worker_id", F.window(F.window_time("slot"), width, slide).alias("w")).agg(
        F.sum("n").alias("pages"), F.sum("bad").alias("fails")
    )
    return sums.select(
        "worker_id",
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "pages",
        "fails",
        round_half_up(F.col("fails") / F.col("pages"), 3).alias("fail_rate"),
    )


def distinct_offers(offers: DataFrame) -> DataFrame:
    """First offer of every URL of a task (ST3). With event time and a watermark the state is bounded."""
    if offers.isStreaming and "ts" in offers.columns:
        return offers.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["task_id", "url"])
    return offers.dropDuplicates(["task_id", "url"])


def running_counters(fetches: DataFrame) -> DataFrame:
    """Counters of each task so far (ST8), in update mode."""
    return task_counters(fetches)


def frame_nodes(reports: DataFrame, tick: str = "3 seconds", late: str = LATE) -> DataFrame:
    """Newest metrics of every worker in each tick (ST9, first half)."""
    at = F.struct("us", "id")
    return reports.withWatermark("ts", late).groupBy(F.window("ts", tick).alias("w"), "worker_id").agg(
        F.max_by("pages_per_min", at).alias("pages_per_min"), F.max_by("fail_rate", at).alias("fail_rate")
    )


def _sum(name: str) -> Column:
    """Sum of doubles that does not depend on the order of the rows: of decimals of 12 places, if all values fit."""
    exact = F.col(name).try_cast("decimal(28,12)")
    return F.when(F.count(exact) == F.count(name), F.sum(exact).cast("double")).otherwise(F.sum(name))


def cluster_points(nodes: DataFrame) -> DataFrame:
    """One point per tick: sum of pages per minute, mean fail rate (ST9)."""
    points = nodes.groupBy("w").agg(
        _sum("pages_per_min").alias("pages_per_min"), F.try_divide(_sum("fail_rate"), F.count("fail_rate")).alias("fail_rate")
    )
    return points.select(F.unix_micros("w.start").alias("frame_us"), "pages_per_min", "fail_rate")


def latest_nodes_sink(reports: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest state of every worker in a table (ST6): reports are folded per micro-batch.

    The table holds one row per worker and column group, so the merge rewrites a cluster-sized table.
    Versions are written side by side, the newest complete one counts; a repeated batch gives the
    same version again.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select(
            "worker_id", "us", "id", "kind", "role", "status", "cpu", "memory_mb", "pages_per_min", "fail_rate"
        )
        if epoch > 0:
            old = spark.read.parquet(f"{table_path}/v{epoch - 1}")
            fresh = fresh.unionByName(old)
        keep = fresh.groupBy("worker_id", "kind").agg(
            F.max_by(F.struct(*[c for c in fresh.columns if c not in ("worker_id", "kind")]), F.struct("us", "id")).alias("r")
        )
        keep.select("worker_id", "kind", "r.*").write.mode("overwrite").parquet(f"{table_path}/v{epoch}")

    return (
        reports.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest_nodes(spark, table_path: str, version: int) -> DataFrame:
    """Node table as the sink left it: the newest metrics and heartbeat of a worker give its state."""
    return node_state(spark.read.parquet(f"{table_path}/v{version}"))


__all__ = [
    "LATE", "SECOND", "cluster_points", "distinct_offers", "frame_nodes", "latest_nodes_sink", "read_latest_nodes",
    "running_counters", "sliding_throughput",
]
