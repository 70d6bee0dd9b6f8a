"""Streams read files one by one; results are compared with the batch forms."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from webloom.operators import spans
from webloom.operators import telemetry as tel
from webloom.sources.tables import decode_jobs
from webloom.streaming import frames, stateful, windows

S = tel.SECOND
DAY = 86_400  # offset of the test times: a row at the very start of the epoch counts as late
_names = itertools.count()


def stream_of(spark, path, df, files, order="us"):
    """The rows of df as a stream of files in time order."""
    rows = df.orderBy(order).collect()
    step = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * step : (i + 1) * step]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)
            for name in sorted(os.listdir(path)):
                if name.endswith(".parquet") and not name.startswith("f"):
                    target = os.path.join(path, f"f{i:03d}.parquet")
                    os.rename(os.path.join(path, name), target)
                    os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(spark, df, mode):
    name = f"out{next(_names)}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture
def few_partitions(spark):
    """Every partition of a stateful stream has a state store and, here, a Python worker of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def hits(spark):
    return spark.range(240).select(
        F.col("id"),
        (F.col("id") * 1_500_000).alias("us"),
        F.timestamp_micros(F.col("id") * 1_500_000).alias("ts"),
        F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("worker_id"),
        F.when(F.col("id") % 5 == 0, 429).otherwise(200).alias("status"),
        (F.col("id") % 4).alias("task_id"),
        F.concat(F.lit("http://h/"), (F.col("id") % 17).cast("string")).alias("url"),
    )


def test_sliding_throughput(spark, hits, tmp_path):
    stream = windows.sliding_throughput(stream_of(spark, str(tmp_path / "in"), hits, 4), "60 seconds", "20 seconds")
    got = {tuple(r) for r in collect(spark, stream, "append").collect()}
    batch = {tuple(r) for r in windows.sliding_throughput(hits, "60 seconds", "20 seconds").collect()}
    assert got and got <= batch
    # Windows that the watermark has passed are all there.
    last = max(r[2] for r in got)
    assert {r for r in batch if r[2] <= last} == got


def test_distinct_offers(spark, hits, tmp_path):
    stream = windows.distinct_offers(stream_of(spark, str(tmp_path / "in"), hits.select("us", "ts", "task_id", "url"), 3))
    got = collect(spark, stream, "append").select("task_id", "url")
    want = windows.distinct_offers(hits.select("task_id", "url"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_counters(spark, hits, tmp_path):
    rows = hits.withColumns({"robots_skip": F.lit(False), "results": F.lit(1)})
    stream = windows.running_counters(stream_of(spark, str(tmp_path / "in"), rows, 3))
    got = collect(spark, stream, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tel.task_counters(rows).collect()))


def reports_of(hits):
    return hits.select(
        "worker_id", "us", "id", "ts",
        F.when(F.col("id") % 2 == 0, "metrics").otherwise("heartbeat").alias("kind"),
        F.lit("").alias("role"), F.when(F.col("id") % 7 == 0, "degraded").otherwise("").alias("status"),
        F.col("id").cast("double").alias("cpu"), F.lit(1.0).alias("memory_mb"),
        (F.col("id") * 2.0).alias("pages_per_min"), (F.col("id") / 1000.0).alias("fail_rate"),
    )


def test_cluster_points(spark, hits, tmp_path):
    reports = reports_of(hits).filter("kind = 'metrics'")
    stream = windows.cluster_points(windows.frame_nodes(stream_of(spark, str(tmp_path / "in"), reports, 4), "15 seconds"))
    got = {tuple(r) for r in collect(spark, stream, "append").collect()}
    batch = {tuple(r) for r in windows.cluster_points(windows.frame_nodes(reports, "15 seconds")).collect()}
    assert got and got <= batch


def test_cluster_points_do_not_depend_on_the_order_of_nodes(spark):
    rows = [(0, 0.1, 0.1), (0, 0.2, 0.2), (0, 0.3, 0.3), (1, 1e300, 1e-300), (2, None, None)]
    points = []
    for some in (rows, rows[::-1]):
        nodes = spark.createDataFrame(some, "us long, pages_per_min double, fail_rate double").coalesce(1)
        nodes = nodes.select(F.struct(F.timestamp_micros("us").alias("start")).alias("w"), "pages_per_min", "fail_rate")
        points.append(sorted(map(tuple, windows.cluster_points(nodes).collect())))
    assert points[0] == points[1]
    assert points[0][0] == (0, 0.6, 0.6 / 3) and points[0][1][:2] == (1, 1e300) and points[0][2] == (2, None, None)


def test_latest_nodes_sink(spark, hits, tmp_path):
    reports = reports_of(hits)
    q = windows.latest_nodes_sink(
        stream_of(spark, str(tmp_path / "in"), reports, 3), str(tmp_path / "nodes"), str(tmp_path / "cp")
    )
    q.awaitTermination()
    got = windows.read_latest_nodes(spark, str(tmp_path / "nodes"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tel.node_state(reports).collect()))


def test_metric_frames(spark, hits, tmp_path):
    """A frame per epoch with all nodes of that time; a repeated epoch and files without a header count for nothing."""
    reports, folder = reports_of(hits), str(tmp_path / "frames")
    q = frames.frame_stream(stream_of(spark, str(tmp_path / "in"), reports, 2), folder, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    rows = frames.read_frames(spark, folder).collect()
    assert sorted((r.frame, r.id) for r in rows) == [(f, f"w{w}") for f in (0, 1) for w in range(3)]
    assert {r.ts for r in rows if r.frame == 1} == {"1970-01-01 08:05:58"}
    for frame, seen in ((0, hits.filter("id < 120")), (1, hits)):
        want = frames.frame_nodes_of(tel.node_state(reports_of(seen)))
        got = frames.read_frames(spark, folder).filter(F.col("frame") == frame).select(want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    before = sorted(os.listdir(os.path.join(folder, "nodes")))
    again = frames.StreamFrames(folder)
    batch = frames.frame_nodes_of(tel.node_state(reports)).toArrow().to_batches()
    again.commit([again.write(iter(batch)), None], 1)
    assert sorted(os.listdir(os.path.join(folder, "nodes"))) == before
    again.abort([again.write(iter(batch))], 2)
    again.write(iter(batch))  # a task that was lost: neither committed nor cleared away
    assert len(frames.read_frames(spark, folder).collect()) == 6
    again.commit([again.write(iter([]))], 2)  # a frame without nodes
    assert spark.read.schema(frames.HEADER).json(f"{folder}/_frames/*.json").filter("frame = 2").first().nodes == 0


def test_metric_frame_of_a_batch(spark, hits, tmp_path):
    nodes, folder = tel.node_state(reports_of(hits)).withColumn("role", F.lit('say "hi"\nü')), str(tmp_path / "frames")
    for _ in range(2):
        frames.write_frame(nodes, folder, 7)
    rows = frames.read_frames(spark, folder).collect()
    assert [(r.frame, r.role) for r in rows] == [(7, 'say "hi"\nü')] * 3


def test_job_stream(spark, tmp_path):
    lines = spark.range(4).select(
        F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.lit(5).alias("task_id"), F.lit("u").alias("url"))).alias("value"),
        F.col("id").alias("us"),
    )
    jobs = collect(spark, decode_jobs(stream_of(spark, str(tmp_path / "in"), lines, 2)), "append")
    assert {r.id for r in jobs.collect()} == {"0", "1", "2", "3"} and jobs.first().task_id == 5


def shuffled(spark, path, df, files):
    """As stream_of, but neighbouring files have swapped some of their rows: within the watermark, rows come in any order."""
    return stream_of(spark, path, df.withColumn("_o", F.col("us") + F.when(F.col("id") % 3 == 0, -8 * S).otherwise(0)), files, "_o").drop("_o")


def test_adaptive_rates(spark, few_partitions, tmp_path):
    """The stream equals the batch trace: ties in time, rows out of order, fetches without domain, latency or status."""
    log = spark.range(400).select(
        F.col("id"), F.col("id").alias("fetch_id"),
        (DAY * S + F.col("id") - F.col("id") % 2 + F.floor(F.col("id") / 2) * 4_000_000 + F.when(F.col("id") > 200, 90_000_000).otherwise(0)).alias("us"),
        F.when(F.col("id") % 4 == 0, None).when(F.col("id") % 8 == 1, "").when(F.col("id") % 4 == 2, "b").otherwise("a").alias("domain"),
        F.when((F.col("id") % 13 == 0) | F.col("id").between(50, 60), 429).when(F.col("id") % 29 != 0, 200).alias("status"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 9 * 60.0).alias("latency_ms"), F.when(F.col("id") % 5 != 0, 4.0).alias("base_qps"),
    ).withColumn("ts", F.timestamp_micros("us"))
    got = collect(spark, stateful.adaptive_rates(shuffled(spark, str(tmp_path / "in"), log, 5)), "append")
    want = {r.fetch_id: (r.domain, r.qps) for r in tel.adaptive_trace(log).collect()}
    a = {r.id: (r.domain, r.qps) for r in got.collect()}
    passed = {r.id for r in log.filter(F.col("us") < log.agg(F.max("us")).first()[0] - 10 * S).collect()}
    assert passed <= a.keys() <= want.keys()
    assert all(a[k][0] == want[k][0] and abs(a[k][1] - want[k][1]) < 1e-9 for k in a)
    assert {d for d, _ in a.values()} == {"a", "b", "default"} and len({round(q, 3) for _, q in a.values()}) > 5


def test_expired_leases(spark, few_partitions, tmp_path):
    rows = [
        (1, 1, 0, "lease", 30), (2, 2, 0, "lease", 30), (3, 3, 1, "lease", 31), (4, 2, 10, "ack", 0),
        (5, 3, 40, "ack", 0), (6, 4, 100, "lease", 130), (7, 5, 200, "lease", 900), (8, 6, 300, "lease", 900),
    ]
    events = lease_events(spark, rows)
    got = collect(spark, stateful.expired_leases(stream_of(spark, str(tmp_path / "in"), events, 8)), "append")
    assert {(r.job_id, r.expired_us // S - DAY) for r in got.collect()} == {(1, 30), (3, 31), (4, 130)}


def lease_events(spark, rows):
    return spark.createDataFrame(rows, "id bigint, job_id bigint, sec bigint, kind string, exp bigint").select(
        "id", "job_id", "kind", ((F.col("sec") + DAY) * S).alias("us"), ((F.col("exp") + DAY) * S).alias("expiry_us"),
        F.timestamp_seconds(F.col("sec") + DAY).alias("ts"),
    )


def test_lease_stream_equals_batch(spark, few_partitions, tmp_path):
    """Renewals, ties, an acknowledgement at the very end, missing expiry, late order, a job with most of the rows."""
    rows = [(1, 1, 0, "lease", 10), (2, 1, 10, "ack", None), (3, 2, 0, "lease", 5), (4, 2, 4, "lease", 9), (5, 2, 10, "ack", None),
            (6, 3, 1, "lease", None), (7, 3, 2, "lease", 20), (8, 3, 3, "lease", None), (9, None, 3, "lease", 4), (10, 4, 7, "ack", None)]
    rows += [(100 + i, 9, 2 * i, "ack" if i % 3 == 2 else "lease", None if i % 3 == 2 else 2 * i + 1 + i % 4) for i in range(60)]
    rows += [(99, 50, 300, "lease", 301)]
    events = lease_events(spark, rows)
    want = sorted(map(tuple, spans.expired_leases(events, F.lit((DAY + 290) * S)).collect()))
    cut = sorted(map(tuple, spans.expired_leases(events, F.lit((DAY + 290) * S), rows=7).collect()))
    got = collect(spark, stateful.expired_leases(shuffled(spark, str(tmp_path / "in"), events, 6)), "append")
    assert want == cut == sorted(map(tuple, got.collect()))
    assert {(2, 4), (9, 100), (9, 104)} <= {r[:2] for r in want} and (9, 101) not in {r[:2] for r in want} and not {1, 3, 4, 50} & {r[0] for r in want}
    ends = {r.id: r.outcome for r in spans.lease_ends(events, F.lit((DAY + 290) * S)).collect()}
    assert (ends[1], ends[3], ends[4], ends[7], ends[99]) == ("acked", "renewed", "expired", "renewed", "held")


def test_leases_of_equal_time_and_id_do_not_depend_on_the_order_of_rows(spark, few_partitions, tmp_path):
    """Job 1: a lease and its acknowledgement; 2: two leases, the longer one stands; 3: a lease without an end comes first."""
    rows = [(1, 1, 5, "ack", None), (1, 1, 5, "lease", 20), (2, 2, 5, "lease", 90), (2, 2, 5, "lease", 20), (2, 2, 30, "ack", None),
            (3, 3, 5, "lease", 20), (3, 3, 5, "lease", None), (4, 9, 300, "lease", 301)]
    at = F.lit((DAY + 290) * S)
    for n, some in enumerate((rows, rows[::-1])):
        events = lease_events(spark, some).coalesce(1)
        for cut in (None, 2):
            ends = spans.lease_ends(events, at, rows=cut).select("job_id", ((F.col("expiry_us") / S) - DAY).cast("int"), "outcome")
            assert sorted(map(tuple, ends.collect())) == [(1, 20, "acked"), (2, 20, "renewed"), (2, 90, "acked"), (3, 20, "expired"), (9, 301, "held")]
        got = collect(spark, stateful.expired_leases(stream_of(spark, str(tmp_path / f"in{n}"), events, 1)), "append")
        assert {r.job_id for r in got.collect()} == {r.job_id for r in spans.expired_leases(events, at).collect()} == {3}


def node_reports(spark, rows):
    return spark.createDataFrame(rows, "id bigint, worker_id string, sec bigint").select(
        "id", "worker_id", ((F.col("sec") + DAY) * S).alias("us"), F.timestamp_seconds(F.col("sec") + DAY).alias("ts")
    )


def test_node_liveness(spark, few_partitions, tmp_path):
    rows = [(1, "a", 0), (2, "b", 5), (3, "a", 10), (4, "a", 60), (5, "b", 62), (6, "c", 200), (7, "c", 400), (8, "d", 411)]
    got = collect(spark, stateful.node_liveness(stream_of(spark, str(tmp_path / "in"), node_reports(spark, rows), 8)), "append")
    changes = sorted((r.worker_id, r.us // S - DAY, r.status) for r in got.collect())
    assert changes == [
        ("a", 0, "online"), ("a", 30, "offline"), ("a", 60, "online"), ("a", 80, "offline"),
        ("b", 5, "online"), ("b", 25, "offline"), ("b", 62, "online"), ("b", 82, "offline"),
        ("c", 200, "online"), ("c", 220, "offline"), ("c", 400, "online"),
    ]


def test_liveness_stream_equals_spans(spark, few_partitions, tmp_path):
    rows = [(i, "hot", i * 3 + (40 if i > 30 else 0) + (21 if i > 50 else 0)) for i in range(60)]
    rows += [(100, "edge", 0), (101, "edge", 20), (102, "edge", 41), (103, None, 50), (104, "twice", 9), (105, "twice", 9), (106, "end", 400)]
    reports = node_reports(spark, rows)
    as_of = F.lit((DAY + 390) * S)
    want = spans.online_spans(reports.filter("worker_id IS NULL OR worker_id <> 'end'"), as_of)
    cut = spans.online_spans(reports.filter("worker_id IS NULL OR worker_id <> 'end'"), as_of, rows=7)
    found = sorted(map(tuple, want.collect()))
    assert found == sorted(map(tuple, cut.collect()))
    assert [(w, (a - DAY * S) // S, (b - DAY * S) // S, n, (o - DAY * S) // S) for w, a, b, n, o in found] == [
        ("edge", 0, 20, 2, 40), ("edge", 41, 41, 1, 61), ("hot", 0, 90, 31, 110), ("hot", 133, 190, 20, 210),
        ("hot", 214, 238, 9, 258), ("twice", 9, 9, 2, 29),
    ]
    open_span = spans.online_spans(reports.filter("worker_id = 'twice'"), F.lit((DAY + 29) * S)).first()
    assert open_span.offline_us is None
    got = collect(spark, stateful.node_liveness(shuffled(spark, str(tmp_path / "in"), reports, 6)), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, spans.status_changes(want).collect()))


def test_proxy_pool(spark, tmp_path):
    rows, i = [], 0

    def add(kind, proxy="", ok=True):
        nonlocal i
        i += 1
        rows.append(("w", i, i, kind, proxy, ok))

    for _ in range(9):
        add("next")
    for p in ("x", "y"):
        for _ in range(3):
            add("report", p, False)
    add("next")
    add("report", "z", False)
    add("report", "z", True)
    for _ in range(3):
        add("report", "z", False)
    add("next")
    df = spark.createDataFrame(rows, "pool string, id bigint, us bigint, kind string, proxy_url string, ok boolean")
    out = collect(spark, stateful.proxy_pool(stream_of(spark, str(tmp_path / "in"), df, 4), ["x", " y ", "z", ""]), "append")
    got = {r.id: r for r in out.collect()}
    first = [got[k].assigned for k in range(1, 10)]
    assert {p: first.count(p) for p in "xyz"} == {"x": 3, "y": 3, "z": 3}
    assert sorted(k for k in got if got[k].evicted) == [12, 15, 21]
    assert got[16].assigned == "z"
    # All three are out now: they come back, and the cursor goes on with its eleventh pick.
    assert got[22].assigned == "y"
