"""Spans between events of a key: leases that ran out (ST4, U4) and times a worker was online (ST5).

The batch forms of the streams of the same names. Both look at neighbouring events of a key only, by scans that cut hot
keys into chunks (``ordered.py``). Rows without a key or a time are left out; ties in time go by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.operators.ordered import previous_row, running_count

SECOND = 1_000_000


def _next(df: DataFrame, key: str, cols: dict[str, str], ties: dict[str, Column] | None = None, rows: int | None = None) -> DataFrame:
    """Adds values of the row after, per key; ``ties`` put rows of equal time and id in order, from the last to the first."""
    order = {"_rus": -F.col("us"), "_rid": -F.col("id"), **(ties or {})}
    return previous_row(df.withColumns(order), [key], list(order), cols, rows=rows).drop(*order)


def _known(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & F.col("us").isNotNull())


def lease_ends(events: DataFrame, as_of_us: Column, rows: int | None = None) -> DataFrame:
    """Every lease and how it ended by ``as_of`` (ST4): job_id, id, us, expiry_us, outcome.

    ``events``: job_id, id, us, kind ('lease' or 'ack'), expiry_us. The next event of the job ends a lease: 'acked' or
    'renewed' if it comes by the expiry, else the lease is 'expired'; without any, it is 'held' until the expiry lies
    before ``as_of``. A lease without an expiry is no lease, but ends the one before it. Of events of equal time and id,
    leases come before acknowledgements and those that end earlier first, so the result does not depend on the order of the rows.
    """
    ties = {"_rlease": F.coalesce(F.col("kind") == "lease", F.lit(False)), "_rend": F.coalesce(-F.col("expiry_us"), F.lit(2**63 - 1))}
    both = _next(_known(events, "job_id"), "job_id", {"_next_us": "us", "_next_kind": "kind"}, ties, rows)
    outcome = (
        F.when(F.col("_next_us") > F.col("expiry_us"), "expired")
        .when(F.col("_next_kind") == "lease", "renewed")
        .when(F.col("_next_us").isNotNull(), "acked")
        .when(F.col("expiry_us") < as_of_us, "expired")
        .otherwise("held")
    )
    leases = both.filter((F.col("kind") == "lease") & F.col("expiry_us").isNotNull())
    return leases.select("job_id", "id", "us", "expiry_us", outcome.alias("outcome"))


def expired_leases(events: DataFrame, as_of_us: Column, rows: int | None = None) -> DataFrame:
    """Leases that ran out before ``as_of`` without an acknowledgement or a new lease (ST4)."""
    out = lease_ends(events, as_of_us, rows).filter("outcome = 'expired'")
    return out.select("job_id", "id", F.col("expiry_us").alias("expired_us"))


def online_spans(reports: DataFrame, as_of_us: Column, stale_us: int = 20 * SECOND, rows: int | None = None) -> DataFrame:
    """Times during which a worker was heard of (ST5): worker_id, online_us, last_us, reports, offline_us.

    A span ends ``stale_us`` after the last report that has no other one within that time; ``offline_us`` is NULL while
    the span is open at ``as_of``. ``reports``: worker_id, us, id.
    """
    known = _known(reports, "worker_id").select("worker_id", "us", "id")
    both = previous_row(known, ["worker_id"], ["us", "id"], {"_before": "us"}, rows=rows)
    placed = running_count(both, ["worker_id"], ["us", "id"], "_i", rows=rows)
    starts = placed.filter(F.col("_before").isNull() | (F.col("us") - F.col("_before") > stale_us))
    ends = _next(starts, "worker_id", {"_last": "_before", "_next": "_i"}, rows=rows)
    whole = known.groupBy("worker_id").agg(F.max("us").alias("_top"), F.count(F.lit(1)).alias("_n"))
    last = F.coalesce("_last", "_top")
    offline = F.when(F.col("_next").isNotNull() | (last + stale_us < as_of_us), last + stale_us)
    return ends.join(whole, "worker_id").select(
        "worker_id", F.col("us").alias("online_us"), last.alias("last_us"),
        (F.coalesce(F.col("_next"), F.col("_n") + 1) - F.col("_i")).alias("reports"), offline.alias("offline_us"),
    )


def status_changes(spans: DataFrame) -> DataFrame:
    """Spans as the changes that the stream states: worker_id, status, us."""
    change = F.explode(F.array(
        F.struct(F.lit("online").alias("status"), F.col("online_us").alias("us")),
        F.struct(F.lit("offline").alias("status"), F.col("offline_us").alias("us")),
    ))
    return spans.select("worker_id", change.alias("c")).select("worker_id", "c.*").filter("us IS NOT NULL")
