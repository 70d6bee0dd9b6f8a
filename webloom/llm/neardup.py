"""Operator 1, near duplicates: HyperMinHash sketches, banded registers, estimate, exact check.

A document is the set of its distinct word shingles. Each of ``REGISTERS`` buckets of the hash range
keeps the leading-zero count and ten mantissa bits of its smallest hash (16 bits); an empty bucket
borrows from a bucket chosen by a fixed ranking, so that small sets fill their sketch, too. Bands of
``ROWS`` registers are the join keys. Candidates pass the Jaccard estimate of their registers, corrected
for registers that agree by chance, and are then compared on their full sets.

How hot groups are kept small:

* Equal sets are one class from the start; only the smallest id of a class goes on.
* Classes that share a band key are not paired with each other at first. In each of ``TURNS`` star turns
  a key names one of its members as hub, and a class is compared with the hub of another component that
  its sketch bits are closest to. Confirmed links are contracted, and keys within one component are done.
* Only pairs of classes that share a key and still lie in different components are compared after that,
  filtered inside the join by set sizes, by the marks of their sets and by 128 bits of the sketch. This is
  the step that loses no link: pairs that it leaves out are linked through their component already, differ
  too much in size or in marks, or differ in so many sketch bits that five standard deviations speak
  against the threshold.
* Marks are ``MARKS`` bits, one set by each hash. Sets differ in at least as many hashes as their marks in
  bits, so for sets of up to some thousand shingles they rule out most pairs just below the threshold, and
  never a link; marks of longer sets fill up and rule out less.

At Jaccard 0.8 a pair shares none of the 42 keys with probability 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import WordHashes, blobs, bytes_of, components, keep, list_column, mix, shingles, texts_of, work_folder

REGISTERS = 256
ROWS = 6
BANDS = REGISTERS // ROWS
MANTISSA = 10
SIGMA = 5.0
TURNS = 4
MARKS = 2048

#: Which bucket an empty bucket borrows from: the filled one of lowest rank in its row.
RANK = np.random.default_rng(20240229).random((REGISTERS, REGISTERS)).argsort(axis=1).argsort(axis=1).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Sketch of sorted distinct 64-bit hashes (at least one)."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    filled = bucket[first]
    rest = ((hashes[first] << np.uint64(8)) >> np.uint64(11)).astype(np.float64)  # 53 bits, exact as a double
    fraction, exponent = np.frexp(rest)
    zeros = np.where(rest > 0, 53 - exponent, 54).astype(np.uint16)
    mantissa = np.where(rest > 0, (2 * fraction - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    own = (np.minimum(zeros, 63) << np.uint16(MANTISSA)) | mantissa
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = own
    if len(filled) < REGISTERS:
        empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
        out[empty] = own[RANK[empty][:, filled].argmin(axis=1)]
    return out


def marks(hashes: np.ndarray) -> np.ndarray:
    """MARKS bits, those that the hashes of a set name, as 64-bit words."""
    bits = np.zeros(MARKS, np.uint8)
    bits[(hashes & np.uint64(MARKS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def chance_agreement(n: np.ndarray) -> np.ndarray:
    """Probability that two different minima share a register, for sets of n hashes each (by powers of two)."""
    load = np.maximum(1.0, 2.0 ** np.arange(0, 64) / REGISTERS)[:, None]
    zeros = np.arange(0, 54)[None, :]
    top, low = 2.0 ** -zeros, 2.0 ** -(zeros + 1)
    # Minima fall into the slice of a leading-zero count with this chance, and spread over its mantissas.
    inside = (1 - low) ** load - np.where(zeros == 0, 0.0, (1 - np.minimum(top, 1 - 1e-16)) ** load)
    table = (inside**2).sum(axis=1) / (1 << MANTISSA)
    return table[np.clip(np.round(np.log2(np.maximum(n, 1))), 0, 63).astype(int)]


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of rows of registers."""
    agree, chance = (a == b).mean(axis=1), chance_agreement(np.sqrt(na.astype(float) * nb))
    return (agree - chance) / (1 - chance)


def _slack(n: np.ndarray, share: float, trials: int) -> np.ndarray:
    return SIGMA * np.sqrt(share * (1 - share) / np.minimum(np.maximum(n, 1), trials))


def sketches(docs: DataFrame, size: int, share: float, text: str, key: str) -> DataFrame:
    """(doc_id, n, f0, f1, sketch, marks): set size, 128-bit fingerprint of the set, registers (null if it is empty), marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        words = WordHashes()
        for batch in batches:
            for a, texts in texts_of(batch.column(1)):
                n, prints, rows, marked = [], [], [], []
                for t in texts:
                    hashes = np.unique(shingles(words.of(t), size))
                    n.append(len(hashes))
                    prints.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    rows.append(registers(hashes).tobytes() if len(hashes) else None)
                    marked.append(marks(hashes))
                f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(n)), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), blobs(rows),
                        list_column(np.concatenate(marked), np.full(len(n), MARKS // 64), pa.int64()),
                    ],
                    ["doc_id", "n", "f0", "f1", "sketch", "marks"],
                )

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), bytes_of(F.col(f"`{text}`")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, f0 long, f1 long, sketch binary, marks array<long>")


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, node) for each band of each sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        steps = mix(np.arange(100, 100 + ROWS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            if not len(batch):
                continue
            r = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            r = r[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = mix((r * steps).sum(axis=2, dtype=np.uint64) + tags).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), list_column(keys.reshape(-1), np.full(len(batch), BANDS), pa.int64())], ["node", "keys"]
            )

    return reps.select("node", "sketch").mapInArrow(run, "node long, keys array<long>").select(F.explode("keys").alias("key"), "node")


def sketch_bits(reps: DataFrame, share: float) -> DataFrame:
    """(node, n, s0, s1, most): 128 sketch bits, and how many of them a similar set may differ in at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            n = batch.column(1).to_numpy(zero_copy_only=False)
            r = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            bits = np.packbits((r[:, ::2] & 1).astype(np.uint8), axis=1).view(np.int64).reshape(-1, 2)
            part = (1 - share) / 2
            most = np.ceil(128 * (part + _slack(n, part, 128))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.array(most)], ["node", "n", "s0", "s1", "most"]
            )

    return reps.select("node", "n", "sketch").mapInArrow(run, "node long, n long, s0 long, s1 long, most int")


def _plausible(pairs: DataFrame, reps: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) whose estimate does not rule out the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            ok = estimate(ra, rb, na, nb) >= share - _slack(np.minimum(na, nb), share, REGISTERS)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok))

    left = reps.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ra"))
    right = reps.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("rb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ra", "rb")
    return joined.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold: den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 64):
                part, ok, sets = batch.slice(at, 64), [], {}
                for a, b, ta, tb in zip(*(part.column(i).to_pylist() for i in range(4))):
                    for k, t in ((a, ta), (b, tb)):
                        if k not in sets:
                            sets[k] = np.unique(shingles(words.of(t), size))
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    ok.append(den * both >= num * (len(sets[a]) + len(sets[b]) - both))
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id): the component of every id, its smallest id reachable over links.

    Link: den * |A & B| >= num * |A | B| on sets of ``size``-word shingles. Texts without words (null
    or empty) have an empty set and no links. Rows of equal ids are one document if their texts are
    equal; ids are expected not to be given to different texts (such an id takes part with each of them
    and keeps its smallest component). Rows without id are not documents here and are left out.
    """
    spark, share = docs.sparkSession, num / den
    folder = work_folder(spark, "neardup")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id IS NOT NULL")
    made = keep(sketches(docs, size, share, "text", "doc_id"), folder, "sketches")
    class_of = made.filter("n > 0").groupBy("f0", "f1").agg(F.min("doc_id").alias("node"))
    classes = keep(class_of, folder, "classes")
    sets = made.filter("n > 0").select(F.col("doc_id").alias("node"), "f0", "f1", "n", "sketch", "marks")
    reps = keep(sets.join(classes, ["node", "f0", "f1"]).select("node", "n", "sketch", "marks").dropDuplicates(["node"]), folder, "reps")

    keys = band_keys(reps)
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("key")
    rows = keys.join(shared, "key").join(sketch_bits(reps, share), "node").withColumn("c", F.col("node"))
    rows = keep(rows, folder, "sides-0")
    texts = keep(
        docs.select(F.col("doc_id").alias("node"), bytes_of(F.col("text")).alias("t"))
        .join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]),
        folder, "texts",
    )
    differ = lambda o: F.bit_count(F.col("s0").bitwiseXOR(o("s0"))) + F.bit_count(F.col("s1").bitwiseXOR(o("s1")))
    links, comp = None, None
    for turn in range(TURNS):
        order = F.xxhash64("node", "key", F.lit(turn)).alias("o")  # another member for each key
        hubs = rows.groupBy("key").agg(F.min(F.struct(order, "node", "c", "s0", "s1")).alias("hub"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        met = rows.join(hubs.filter("c0 < c1").select("key", "hub"), "key").filter("c <> hub.c")
        met = met.withColumn("d", differ(lambda x: F.col(f"hub.{x}"))).filter("d <= most")
        best = met.groupBy("node").agg(F.min(F.struct("d", "hub.node")).alias("x"))
        pairs = best.select(F.col("node").alias("a"), F.col("x.node").alias("b"))
        found = keep(_confirmed(_plausible(pairs, reps, share), texts, size, num, den), folder, f"links-{turn}")
        links = found if links is None else links.union(found)
        comp = keep(components(links, folder, f"star-{turn}"), folder, f"comp-{turn}")
        rows = rows.drop("c").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        mixed = rows.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("key")
        rows = keep(rows.join(mixed, "key", "left_semi"), folder, f"sides-{turn + 1}")

    rows = rows.join(reps.select("node", "marks"), "node")
    other = rows.select("key", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "s0", "s1", "most", "c", "marks")])
    apart = sum(F.bit_count(F.col("marks")[i].bitwiseXOR(F.col("marks_")[i])) for i in range(MARKS // 64))
    rest = (
        rows.join(other, "key")
        .filter((F.col("node") < F.col("node_")) & (F.col("c") != F.col("c_")))
        .filter((den * F.col("n") >= num * F.col("n_")) & (den * F.col("n_") >= num * F.col("n")))
        .filter(differ(lambda x: F.col(f"{x}_")) <= F.greatest("most", "most_"))
        .filter((den + num) * apart <= (den - num) * (F.col("n") + F.col("n_")))
        .select(F.col("node").alias("a"), F.col("node_").alias("b")).distinct()
    )
    found = keep(_confirmed(_plausible(rest, reps, share), texts, size, num, den), folder, "links-rest")
    comp = components(links.union(found), folder, "all")

    of_class = classes.join(comp, "node", "left").select("f0", "f1", F.coalesce("component", "node").alias("component"))
    out = made.select("doc_id", "n", "f0", "f1").join(of_class, ["f0", "f1"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
