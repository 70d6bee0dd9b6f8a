"""Metric frames as a sink (S8): a JSON line per node, a header per frame, for batches and streams.

A task writes the lines of its nodes to a file of its own; the commit of the epoch writes the frame's header, which names
those files. A frame exists from then on. An epoch that is committed again (after a restart) keeps its first header, so
it counts once; files that no header names are not read. The folder may lie on any file system that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from webloom.functions.clock import format_instant
from webloom.operators.telemetry import node_state

HEADERS, LINES = "_frames", "nodes"
HEADER = "frame long, type string, nodes long, last_seen_us long, files array<string>"
NODE = (
    "id string, role string, cpu double, memory_mb double, pages_per_min double, fail_rate double, status string, "
    "last_seen string, last_seen_us long"
)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, their lines and the newest report among them."""

    files: list = field(default_factory=list)
    nodes: int = 0
    newest: int | None = None


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_lines(folder: str, batches: Iterator) -> Written:
    """The rows of a task as JSON lines in one new file; no rows make no file."""
    done, out, name = Written(), None, f"{uuid.uuid4().hex}.jsonl"
    for batch in batches:
        rows = batch.to_pylist()
        if rows and out is None:
            store, path = _store(folder)
            store.create_dir(f"{path}/{LINES}", recursive=True)
            out = store.open_output_stream(f"{path}/{LINES}/{name}")
            done.files.append(name)
        for row in rows:
            out.write((json.dumps(row, ensure_ascii=False) + "\n").encode())
        done.nodes += len(rows)
        seen = [r["last_seen_us"] for r in rows if r["last_seen_us"] is not None]
        done.newest = max([*seen, *([] if done.newest is None else [done.newest])], default=None)
    if out is not None:
        out.close()
    return done


def write_header(folder: str, frame: int, messages: list) -> bool:
    """Make a frame of what the tasks wrote; False if the frame is there already, whose files then stay the only ones."""
    from pyarrow.fs import FileType

    store, path = _store(folder)
    target = f"{path}/{HEADERS}/{frame:020d}.json"
    parts = [m for m in messages if m is not None]
    if store.get_file_info(target).type != FileType.NotFound:
        discard(folder, parts)
        return False
    newest = max((m.newest for m in parts if m.newest is not None), default=None)
    header = {"frame": frame, "type": "metrics", "nodes": sum(m.nodes for m in parts), "last_seen_us": newest, "files": [f for m in parts for f in m.files]}
    store.create_dir(f"{path}/{HEADERS}", recursive=True)
    hidden = f"{path}/{HEADERS}/.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(json.dumps(header).encode())
    store.move(hidden, target)
    return True


def discard(folder: str, messages: list) -> None:
    """Delete what tasks of a write that does not count left behind."""
    store, path = _store(folder)
    for m in messages:
        for name in m.files if m is not None else ():
            store.delete_file(f"{path}/{LINES}/{name}")


class MetricFrames(DataSource):
    """``df.write.format("metric_frames").option("path", folder)``; ``frame`` is the number of a batch's frame (default 0)."""

    @classmethod
    def name(cls) -> str:
        return "metric_frames"

    def writer(self, schema, overwrite: bool) -> "BatchFrames":
        return BatchFrames(self.options["path"], int(self.options.get("frame", 0)))

    def streamWriter(self, schema, overwrite: bool) -> "StreamFrames":
        return StreamFrames(self.options["path"])


class BatchFrames(DataSourceArrowWriter):
    def __init__(self, folder: str, frame: int):
        self.folder, self.frame = folder, frame

    def write(self, iterator) -> Written:
        return write_lines(self.folder, iterator)

    def commit(self, messages) -> None:
        write_header(self.folder, self.frame, messages)

    def abort(self, messages) -> None:
        discard(self.folder, messages)


class StreamFrames(DataSourceStreamArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> Written:
        return write_lines(self.folder, iterator)

    def commit(self, messages, batchId: int) -> None:
        write_header(self.folder, batchId, messages)

    def abort(self, messages, batchId: int) -> None:
        discard(self.folder, messages)


def frame_nodes_of(nodes: DataFrame) -> DataFrame:
    """Columns of a node as a frame carries them."""
    seen = format_instant(F.timestamp_micros("last_seen_us")).alias("last_seen")
    return nodes.select(F.col("worker_id").alias("id"), "role", "cpu", "memory_mb", "pages_per_min", "fail_rate", "status", seen, "last_seen_us")


def write_frame(nodes: DataFrame, folder: str, frame: int = 0) -> None:
    """The frame of a table of nodes; a frame that is there already is kept."""
    nodes.sparkSession.dataSource.register(MetricFrames)
    frame_nodes_of(nodes).write.format("metric_frames").mode("append").option("path", folder).option("frame", frame).save()


def frame_stream(reports: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A frame of all nodes per trigger (``processingTime="3 seconds"`` unless stated)."""
    reports.sparkSession.dataSource.register(MetricFrames)
    out = frame_nodes_of(node_state(reports)).writeStream.outputMode("complete").format("metric_frames")
    return out.option("path", folder).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of all frames: frame, ts (time of the frame's newest report), then the columns of a node."""
    heads = spark.read.schema(HEADER).json(f"{folder}/{HEADERS}/*.json")
    ts = format_instant(F.timestamp_micros("last_seen_us")).alias("ts")
    files = heads.select("frame", ts, F.explode("files").alias("_file"))
    # Column metadata gives the file of a line; there are as many files as tasks wrote.
    lines = spark.read.schema(NODE).json(f"{folder}/{LINES}/*.jsonl").select("*", F.col("_metadata.file_name").alias("_file"))
    return files.join(lines, "_file").drop("_file")
