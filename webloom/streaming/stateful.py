"""Keyed state over streams: adaptive rate, lease expiry, node liveness, proxy pool (ST2, ST4, ST5, ST7).

The first three take the rows of a key in event-time order, whatever order they arrive in within the watermark: rows
wait in a list state until the watermark has passed them, a timer then hands on those that are due. Their results are
those of the batch forms (``adaptive_trace``, ``expired_leases`` and ``online_spans`` in ``operators``) for all rows that
the watermark has passed. Rows later than the watermark are dropped, rows without a key (but for domains) are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

WINDOW_US = 30_000_000
MIN_QPS, DEFAULT_QPS = 0.2, 2.0
STALE_US = 20_000_000
FAIL_LIMIT = 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(pdfs: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in this micro-batch, by event time."""
    return pd.concat(list(pdfs)).sort_values(["us", "id"])


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``take`` in order of (us, id) once the watermark has passed them.

    ``ROW`` is the schema of a waiting row, ``us`` and ``id`` first; ``OUT`` that of the results, the key first.
    """

    ROW = "us bigint, id bigint"
    OUT = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.ROW)

    def handleInputRows(self, key, rows, timerValues):
        columns = [c.split(" ") for c in self.ROW.split(", ")]
        first = None
        for pdf in rows:
            if len(pdf):
                # Whole numbers with NULLs among them come as floats.
                values = [[None if pd.isna(v) else int(v) if kind.endswith("int") else v for v in pdf[c].tolist()] for c, kind in columns]
                self.waiting.appendList(list(zip(*values, strict=True)))
                first = min(values[0]) if first is None else min(first, *values[0])
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield self.results(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000  # every row before this time has come
        rows = sorted(self.waiting.get(), key=self.order)
        due = [r for r in rows if r[0] < upto]
        if len(due) == len(rows):
            self.waiting.clear()
        elif due:
            self.waiting.put(rows[len(due) :])
            self.handle.registerTimer(rows[len(due)][0] // 1000 + 1)
        yield self.results(key, self.take(due, upto))

    def results(self, key, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in self.OUT.split(", ")]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=names)

    def order(self, row: tuple) -> tuple:
        return row[:2]

    def take(self, due: list[tuple], upto: int) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _by_event_time(rows: DataFrame, key: str, late: str, processor: InOrder) -> DataFrame:
    """Runs a processor per key; its state needs the RocksDB store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kept = rows.withWatermark("ts", late).filter(F.col(key).isNotNull() & F.col("us").isNotNull())
    return kept.groupBy(key).transformWithStateInPandas(processor, processor.OUT, "Append", "EventTime")


# Adaptive rate (ST2) ------------------------------------------------------------------------------


class Rates(InOrder):
    """The rate and, per time, the sums of the fetches of the last 30 s: times expire one by one."""

    ROW = "us bigint, id bigint, status int, latency_ms double, base_qps double"
    OUT = "domain string, id bigint, us bigint, qps double"

    def init(self, handle) -> None:
        super().init(handle)
        self.rate = handle.getValueState("rate", "qps double")
        self.recent = handle.getMapState("recent", "us bigint", "n bigint, bad bigint, latency_us bigint")

    def take(self, due, upto):
        if not due:
            return []
        held = sorted((k[0], tuple(v)) for k, v in self.recent.iterator())
        stored = {us for us, _ in held}
        sums = [sum(v[c] for _, v in held) for c in range(3)]
        qps = self.rate.get()[0] if self.rate.exists() else 0.0
        out, first, at = [], 0, 0
        while at < len(due):
            us, end = due[at][0], at
            while end < len(due) and due[end][0] == us:  # fetches of one time count together
                end += 1
            same = due[at:end]
            entry = (
                len(same), sum(r[2] in (429, 403) for r in same),
                sum(math.floor(r[3] * 1000 + 0.5) for r in same if r[3] is not None),
            )
            held.append((us, entry))
            sums = [a + b for a, b in zip(sums, entry)]
            while held[first][0] <= us - WINDOW_US:
                old, gone = held[first]
                sums = [a - b for a, b in zip(sums, gone)]
                if old in stored:
                    self.recent.removeKey((old,))
                first += 1
            factor = _factor(sums[1] / sums[0], sums[2] / sums[0] / 1000)
            for row in same:
                base = row[4] if row[4] is not None and row[4] > 0 else DEFAULT_QPS
                qps = min(base, max(MIN_QPS, (qps if qps > 0 else base) * factor))
                out.append((row[1], us, qps))
            at = end
        for us, entry in held[first:]:
            if us not in stored:
                self.recent.updateValue((us,), entry)
        self.rate.update((float(qps),))
        return out


def _factor(ratio: float, avg_ms: float) -> float:
    if ratio >= 0.2:
        return 0.5
    if ratio >= 0.05:
        return 0.75
    if avg_ms > 1500:
        return 0.85
    return 1.08 if ratio == 0 and avg_ms < 400 else 1.0


def adaptive_rates(log: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Rate of each domain after every fetch: domain, id, us, ts, status, latency_ms, base_qps in (ST2).

    Fetches without a domain belong to the domain ``default``, those without a latency count as 0 ms.
    """
    named = log.withColumn("domain", F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.lit("default")))
    typed = named.withColumns({"status": F.col("status").cast("int"), "latency_ms": F.col("latency_ms").cast("double"), "base_qps": F.col("base_qps").cast("double")})
    return _by_event_time(typed, "domain", late, Rates())


# Lease expiry (ST4) -------------------------------------------------------------------------------


class Leases(InOrder):
    """The running lease of a job; a timer stands right behind its end."""

    ROW = "us bigint, id bigint, kind string, expiry_us bigint"
    OUT = "job_id bigint, id bigint, expired_us bigint"

    def init(self, handle) -> None:
        super().init(handle)
        self.lease = handle.getValueState("lease", "id bigint, expiry_us bigint")

    def order(self, row):
        us, id, kind, expiry = row
        return us, id, kind != "lease", expiry is not None, expiry or 0

    def take(self, due, upto):
        out = []
        now = self.lease.get() if self.lease.exists() else None
        before = now
        for us, id, kind, expiry in due:
            if now is not None and us > now[1]:
                out.append(tuple(now))
            now = (id, expiry) if kind == "lease" and expiry is not None else None
        if now is not None and now[1] < upto:
            out.append(tuple(now))
            now = None
        if now is None:
            if before is not None:
                self.lease.clear()
        elif now != before:
            self.lease.update(tuple(now))
            self.handle.registerTimer(now[1] // 1000 + 1)
        return out


def expired_leases(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Leases that ran out without an acknowledgement or a new lease (ST4): their jobs go back to the ready queue.

    ``events``: job_id, id, ts, us, kind ('lease' or 'ack'), expiry_us. An event at the very end of a lease is in time.
    """
    return _by_event_time(events, "job_id", late, Leases())


# Node liveness (ST5) ------------------------------------------------------------------------------


class Liveness(InOrder):
    """The last report of a worker that is online."""

    OUT = "worker_id string, status string, us bigint"

    def __init__(self, stale_us: int):
        self.stale_us = stale_us

    def init(self, handle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "us bigint")

    def take(self, due, upto):
        out, last = [], self.seen.get()[0] if self.seen.exists() else None
        before = last
        for us, _ in due:
            if last is not None and us - last > self.stale_us:
                out.append(("offline", last + self.stale_us))
                last = None
            if last is None:
                out.append(("online", us))
            last = us
        if last is not None and last + self.stale_us < upto:
            out.append(("offline", last + self.stale_us))
            last = None
        if last is None:
            if before is not None:
                self.seen.clear()
        elif last != before:
            self.seen.update((last,))
            self.handle.registerTimer((last + self.stale_us) // 1000 + 1)
        return out


def node_liveness(reports: DataFrame, late: str = "10 seconds", stale_us: int = STALE_US) -> DataFrame:
    """Status changes of workers: online on a report, offline 20 s after the last one (ST5).

    ``reports``: worker_id, id, ts, us. A change is stated once the watermark has passed it.
    """
    return _by_event_time(reports, "worker_id", late, Liveness(stale_us))


# Proxy pool (ST7) ---------------------------------------------------------------------------------


def _pool_step(proxies: list[str]):
    size = len(proxies)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, consec, evicted = state.get if state.exists else (0, [0] * size, [0] * size)
        consec, evicted = list(consec), list(evicted)
        rows = _in_order(pdfs)
        assigned, dropped = [], []
        for kind, proxy, ok in zip(rows["kind"], rows["proxy_url"], rows["ok"], strict=True):
            pick, out = None, False
            if kind == "next":
                alive = [i for i in range(size) if not evicted[i]]
                if not alive:
                    consec, evicted = [0] * size, [0] * size
                    alive = list(range(size))
                if alive:
                    pick = proxies[alive[cursor % len(alive)]]
                    cursor += 1
            elif proxy in proxies:
                i = proxies.index(proxy)
                consec[i] = 0 if ok else consec[i] + 1
                if consec[i] >= FAIL_LIMIT and not evicted[i]:
                    evicted[i], out = 1, True
            assigned.append(pick)
            dropped.append(out)
        state.update((int(cursor), consec, evicted))
        yield pd.DataFrame(
            {"pool": key[0], "id": rows["id"], "assigned": pd.Series(assigned, dtype=object, index=rows.index),
             "evicted": dropped}
        )

    return step


def proxy_pool(events: DataFrame, proxies: list[str]) -> DataFrame:
    """Round robin over the alive proxies, eviction after three failures in a row, revival of all
    when none is left (ST7, W6 with history). One pool per crawling process: its events are its key.

    ``events``: pool, id, us, kind ('next' or 'report'), proxy_url, ok.
    """
    return events.groupBy("pool").applyInPandasWithState(
        _pool_step([p.strip() for p in proxies if p.strip()]),
        "pool string, id bigint, assigned string, evicted boolean",
        "cursor bigint, consec array<bigint>, evicted array<bigint>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
