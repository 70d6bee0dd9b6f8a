"""Operator 6, WARC: archives as a Python data source, and a writer that stores equal payloads once.

Archives hold one gzip member per record. Files are cut into pieces of about ``split_bytes``; a piece
holds the members that begin in it, found through the offsets that the writer left in ``<file>.cdx``
or, without them, by reading the file from its start (one piece). Of a member only the header is
inflated at first; records that fail the pushed predicates are passed by without inflating the rest.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to long, page_id long, payload_bytes long, file string, offset long, payload binary"
COLUMNS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
#: Columns that come from headers alone; predicates on them can be pushed down.
HEADER = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "x-refers-to-page", "page_id": "x-page-id", "payload_bytes": "x-payload-length",
}
NUMBERS = ("page_id", "payload_bytes", "refers_to")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Writing --------------------------------------------------------------------------------------


def _urn(page: int | None, key: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {key} {kind}')}>"


def _record(kind: str, page: int | None, uri: str | None, key: str, size: int, payload: bytes, refers: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page, key, kind)}"]
    # A URI that would break the header is left out.
    if uri is not None and uri == uri.strip() and not any(c in uri for c in "\r\n"):
        lines.append(f"WARC-Target-URI: {uri}")
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{key}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        lines += [f"WARC-Refers-To: {_urn(refers, key, 'response')}", f"X-Refers-To-Page: {refers}"]
    body = b"" if kind == "revisit" else payload
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


MANIFEST = "file string, records long, size long"


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write a record per row of (page_id, url, html); gives the manifest of the files written.

    Of rows with equal payloads of at least ``min_bytes``, that with the largest page_id becomes a
    response and the others revisit it; a row without page_id is a response only if all of its
    group have none. Smaller payloads are all responses. Rows that repeat a page_id with an equal
    payload are all of one kind; null html is an empty payload. Which page is the response is found on
    digests alone, combined before the shuffle; payloads cross one shuffle at most, by page.
    Tasks write under names of their own, and only files of tasks that succeeded enter the manifest.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("p"))
    rows = rows.withColumn("hex", F.sha1("p")).withColumn("size", F.length("p").cast("long"))
    latest = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), html.alias("p"))
        .select("page_id", F.sha1("p").alias("hex"))
        .groupBy("hex").agg(F.max("page_id").alias("latest"))
    )
    slim = rows.select("page_id", "hex", "size").join(latest, "hex").filter(
        (F.col("size") >= min_bytes) & F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    )
    revisits = slim.select("page_id", "hex", F.col("latest").alias("refers")).distinct()
    marked = rows.join(
        revisits.select(F.col("page_id").alias("rp"), F.col("hex").alias("rh"), "refers"),
        F.col("page_id").eqNullSafe(F.col("rp")) & (F.col("hex") == F.col("rh")),
        "left",
    ).select("page_id", "url", "hex", "size", "refers", F.when(F.col("refers").isNull(), F.col("p")).alias("p"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as files

        store, path = files.FileSystem.from_uri(folder)
        name, out, at, index = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0, []
        for r in (r for b in batches for i in range(0, len(b), 256) for r in zip(*(c.to_pylist() for c in b.slice(i, 256).columns))):
                page, url, key, size, refers, payload = r
                if out is None:
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                key = base64.b32encode(bytes.fromhex(key)).decode()
                kind = "response" if refers is None else "revisit"
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = gz.compress(_record(kind, page, url, key, size, payload or b"", refers)) + gz.flush()
                out.write(raw)
                index.append(at)
                at += len(raw)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{name}.cdx", compression=None) as f:
                f.write(struct.pack(f"<{len(index)}q", *index))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([at], pa.int64())], ["file", "records", "size"])

    marked.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# Reading --------------------------------------------------------------------------------------


class Piece(InputPartition):
    def __init__(self, path: str, first: int, end: int | None, starts: bool):
        self.path, self.first, self.end, self.starts = path, first, end, starts


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options ``split_bytes`` (default 8 MiB), ``payload`` (default true)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "WarcReader":
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.split = int(options.get("split_bytes", 8 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.wanted: dict[str, set] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):
        """Equality, IN and IS NOT NULL on columns that headers give are decided by the reader."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, IsNotNull) and column in HEADER:
                self.present.add(column)
            elif isinstance(f, (EqualTo, In)) and column in HEADER:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        """Pieces of the files that the folder's manifest names, or of all archives if there is none."""
        import pyarrow.dataset as ds
        from pyarrow import fs as files

        store, path = files.FileSystem.from_uri(self.folder)
        found = store.get_file_info(files.FileSelector(path, recursive=False))
        sizes = {f.base_name: f.size for f in found if f.is_file}
        names = [n for n in sizes if n.endswith((".warc", ".warc.gz"))]
        if any(f.base_name == "manifest" for f in found):
            listed = ds.dataset(f"{path}/manifest", filesystem=store, format="parquet", exclude_invalid_files=True)
            names = listed.to_table(columns=["file"]).column("file").to_pylist() if listed.files else []
        pieces = []
        for n in sorted(names):
            if f"{n}.cdx" in sizes:
                ends = [*range(0, sizes[n], self.split), sizes[n]]
                pieces += [Piece(f"{self.folder}/{n}", a, b, True) for a, b in zip(ends, ends[1:])]
            else:
                pieces.append(Piece(f"{self.folder}/{n}", 0, None, False))
        return pieces or [Piece("", 0, 0, False)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        import pyarrow as pa
        from pyarrow import fs as files

        kinds = [pa.int64() if c in (*NUMBERS, "offset") else pa.binary() if c == "payload" else pa.string() for c in COLUMNS]
        store, path = files.FileSystem.from_uri(piece.path)
        rows, room = [], 0
        with store.open_input_file(path) as f:
            for offset, head, body in _members(f, piece, store, path):
                row = {c: head.get(h) for c, h in HEADER.items()}
                for c in NUMBERS:
                    row[c] = int(row[c]) if row[c] is not None else None
                if row["payload_digest"] and ":" in row["payload_digest"]:
                    row["payload_digest"] = row["payload_digest"].partition(":")[2]
                if row["payload_bytes"] is None and row["record_type"] != "revisit":
                    row["payload_bytes"] = int(head.get("content-length", 0))
                if any(row[c] is None for c in self.present) or any(row[c] not in v for c, v in self.wanted.items()):
                    continue
                payload = body() if self.payload and row["record_type"] != "revisit" else None
                rows.append([*(row[c] for c in COLUMNS[:8]), path.rpartition("/")[2], offset, payload])
                room += len(payload or b"") + 500
                if room > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], COLUMNS)
                    rows, room = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], COLUMNS)


def _headers(block: bytes) -> dict[str, str]:
    found = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


def _members(f, piece: Piece, store, path: str):
    """(offset, headers, function that gives the payload) of the records that begin in a piece."""
    if piece.starts:
        with store.open_input_file(f"{path}.cdx") as x:
            raw = x.read()
        starts = struct.unpack(f"<{len(raw) // 8}q", raw)
        ends = [*starts[1:], f.size()]
        for a, b in zip(starts, ends):
            if piece.first <= a < piece.end:
                f.seek(a)
                data = f.read(b - a)
                yield a, *_lazy(data)
        return
    data, at = f.read(), 0
    packed = data[:2] == b"\x1f\x8b"
    while at < len(data):
        if packed:
            head, body, used = _open(data[at:])
        else:
            stop = data.index(b"\r\n\r\n", at) + 4
            head = _headers(data[at:stop])
            size = int(head.get("content-length", 0))
            body, used = (lambda s=stop, n=size: data[s : s + n]), stop + size + 4 - at
        yield at, head, body
        at += used


def _lazy(data: bytes):
    """Headers of one member; the payload is inflated only when it is asked for."""
    z = zlib.decompressobj(31)
    got, rest = z.decompress(data, 1024), None
    while (stop := got.find(b"\r\n\r\n")) < 0 and not z.eof and z.unconsumed_tail:
        got += z.decompress(z.unconsumed_tail, 1024)
    head = _headers(got[:stop])

    def body() -> bytes:
        rest = got[stop + 4 :] + z.decompress(z.unconsumed_tail)
        return rest[: int(head.get("content-length", 0))]

    return head, body


def _open(data: bytes):
    z = zlib.decompressobj(31)
    whole = z.decompress(data)
    stop = whole.index(b"\r\n\r\n")
    head = _headers(whole[:stop])
    size = int(head.get("content-length", 0))
    return head, (lambda: whole[stop + 4 : stop + 4 + size]), len(data) - len(z.unused_data)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """All records of a folder of archives; predicates on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(folder)
