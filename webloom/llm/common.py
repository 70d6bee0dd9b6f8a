"""Helpers shared by the operators: work tables, words and shingles as hashes, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Odd multipliers of the words of a shingle (fixed, so that hashes agree between jobs).
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                  0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
CACHE_WORDS = 400_000


# Work tables ----------------------------------------------------------------------------------


def work_folder(spark: SparkSession, name: str) -> str:
    """New folder for work tables inside spark.checkpoint.dir; deleted when the driver ends.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(shared)
    folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    path, fs = _hadoop(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return re.sub("^file:/+", "file:///", str(fs.makeQualified(path).toString()))


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(df: DataFrame, folder: str, name: str, codec: str = "snappy") -> DataFrame:
    """Write a work table and read it back: lineage ends here and outlives the executors."""
    df.write.option("compression", codec).parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def discard(spark: SparkSession, folder: str, name: str) -> None:
    path, fs = _hadoop(spark, f"{folder}/{name}")
    fs.delete(path, True)


def bytes_of(text: Column) -> Column:
    """A text column for Python: UTF-8 bytes, null as none."""
    return F.coalesce(text, F.lit("")).cast("binary")


def spans(sizes: np.ndarray, most: int = 1 << 20):
    """Cut rows of these sizes into runs of about ``most`` bytes, at least one row each."""
    at, room = 0, 0
    for i, n in enumerate(sizes):
        if i > at and room + n > most:
            yield at, i
            at, room = i, 0
        room += int(n)
    if at < len(sizes):
        yield at, len(sizes)


def texts_of(column: pa.Array, most: int = 1 << 20):
    """(first row, list of byte strings) for runs of about ``most`` bytes of a binary column."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for a, b in spans(sizes, most):
        yield a, column.slice(a, b - a).to_pylist()


def list_column(values: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def blobs(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


# Words and shingles ---------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash of each word, kept while there are few of them."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, as hashes in order."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words in order; fewer words make one shingle, no word makes none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += words[j : j + n] * STEPS[j % len(STEPS)] * np.uint64(2 * (j // len(STEPS)) + 1)
    return mix(total)


# Order ------------------------------------------------------------------------------------------


def ranked(df: DataFrame, order: list[Column], folder: str, name: str, into: str) -> DataFrame:
    """Rows with their place (from 1) in a total order: sorted by ranges, counted by partition, no task holds them all."""
    at = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), folder, name)
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    start = F.broadcast(sizes.select("__part", before.alias("__before")))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn("__part", part).join(start, "__part").withColumn(into, place).drop("__part", "__at", "__before")


# Connected components -------------------------------------------------------------------------


def components(edges: DataFrame, folder: str, tag: str) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component = smallest node reachable.

    Alternating large-star and small-star steps: every step is a minimum per node (combined before
    the shuffle) and a join of edges, so no group is gathered; each round is written and the
    one before it deleted. Rounds end when a round leaves the edges as they were. Loops are dropped.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = keep(now, folder, f"{tag}-0")
    seal, turn = None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seal or not mark["n"]:
            break
        seal, turn = mark, turn + 1
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b").filter("a <> b").distinct()
        )
        now = keep(small, folder, f"{tag}-{turn}")
        if turn > 1:
            discard(spark, folder, f"{tag}-{turn - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
