"""Operator 13, n-gram Jaccard join: adaptive prefixes that ask for several shared tokens.

A document is the set of its distinct word shingles (64-bit hashes), put into one global order: rare first, by a
frequency table that every task uses alike. Two sets x and y that reach the threshold share at least
``need(x) = ceil(threshold * |x|)`` hashes, and as many for y. Then, for any k, the first k hashes that they share lie
within the first ``|x| - need(x) + k`` hashes of x and the first ``|y| - need(y) + k`` of y: fewer than need - k would
be left to share behind. So a prefix longer by k - 1 may ask for k shared hashes, and a pair of documents with
prefixes for k and l has to share min(k, l) of them. No link is lost, whatever k each document takes.

Each document chooses its own k, up to ``LONGEST``. The frequencies of its hashes estimate how many entries of other
documents a prefix meets; a prefix costs its own entries, those that it meets, and a verification in proportion to the
document's size for every k entries met. Documents of rare hashes keep the shortest prefix, documents of frequent
ones ask for more shared hashes.

The table counts the hashes of all documents in ``SLOTS`` counters, by their lower bits. Its mean is noise that many
different hashes make, and is not taken for entries. The table orders hashes and prices prefixes, it never decides a
link, and its size is fixed.

Hot groups are kept small like this:

* Equal sets are one class from the start, and one of its texts goes on.
* In star turns, each prefix hash names one of its documents as hub, and each document is verified against the
  hub of another component with which it shares most. Links found are contracted; hashes left inside one
  component are done. Turns end when one finds nothing, after ``TURNS`` at most.
* Pairs of different components are then counted in full. A hash that many documents still have is cut into
  blocks of about ``BLOCK`` documents and each pair of blocks is a join key of its own, so no task gets all of a hash.
* Pairs with too few shared prefix hashes, unlike sizes or too unlike marks are not verified; none of these tests can
  drop a link. Marks are ``MARKS`` parity bits, each turned by the hashes that fall on it: sets differ in as many hashes
  at least as their marks in bits. Inside the join of a hash, marks of ``FOLD`` bits drop most pairs before they are
  counted, so a group of many documents that are alike but not linked makes few rows.

Verification compares whole sets, made anew from the texts of the documents concerned; a text that many pairs need is
copied for every ``SHARE`` of them. Texts move once, to be brought together with their class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import WordHashes, blobs, bytes_of, components, keep, list_column, shingles, texts_of, work_folder

SLOTS = 1 << 21
SLICES = 64
LONGEST = 16
#: Price of comparing one shingle of a pair, in index entries.
VERIFY = 0.25
TURNS = 2
BLOCK = 256
MARKS = 2048
FOLD = 512
SHARE = 512


# Sets, frequencies, prefixes ------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    """(batch, first row, sorted sets) for runs of texts in the second column."""
    words = WordHashes()
    for batch in batches:
        for a, texts in texts_of(batch.column(1)):
            yield batch, a, [np.unique(shingles(words.of(t), size)) for t in texts]


def _prints(sets: list[np.ndarray]) -> list[pa.Array]:
    import xxhash

    f = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
    return [pa.array(f[:, 0]), pa.array(f[:, 1])]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _packed(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Filled counters of each slice of the table."""
    for k, part in enumerate(table.reshape(SLICES, -1)):
        filled = np.flatnonzero(part)
        if len(filled):
            yield k, zlib.compress(filled.astype(np.uint32).tobytes() + part[filled].tobytes(), 1)


def _add(part: np.ndarray, packed: bytes) -> None:
    raw = zlib.decompress(packed)
    n = len(raw) // 12
    part[np.frombuffer(raw, np.uint32, n)] += np.frombuffer(raw[4 * n :], np.int64)


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """A row (doc_id, n, f0, f1) for each text, and one (slice, counts) for each slice of a task's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, np.int64)
        for batch, a, sets in _sets(batches, size):
            np.add.at(table, _slots(np.concatenate(sets)), 1)
            n, sizes = len(sets), pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), sizes, *_prints(sets), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        none = pa.nulls(1, pa.int64())
        for k, packed in _packed(table):
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k], pa.int32()), blobs([packed])], names)

    names = ["doc_id", "n", "f0", "f1", "slice", "counts"]
    return docs.mapInArrow(run, "doc_id long, n long, f0 long, f1 long, slice int, counts binary")


def _frequencies(profiles: DataFrame) -> np.ndarray:
    """The table; the rows of a slice are added up as they pass, in 16 tasks first and then in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _add(total.setdefault(k, np.zeros(SLOTS // SLICES, np.int64)), packed)
        for k, part in total.items():
            filled = np.flatnonzero(part)
            packed = zlib.compress(filled.astype(np.uint32).tobytes() + part[filled].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), blobs([packed])], ["slice", "counts"])

    parts = profiles.filter("slice IS NOT NULL").select("slice", "counts")
    parts = parts.repartition("slice", F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(run, "slice int, counts binary")
    parts = parts.repartition("slice").mapInArrow(run, "slice int, counts binary")
    table = np.zeros((SLICES, SLOTS // SLICES), np.int64)
    for r in parts.collect():  # SLOTS counters, whatever the input
        _add(table[r["slice"]], bytes(r["counts"]))
    return np.minimum(table.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def prefix(hashes: np.ndarray, table: np.ndarray, noise: float, num: int, den: int) -> tuple[int, np.ndarray]:
    """(k, first hashes in the global order) of a sorted set: the cheapest k, and the prefix that asks for k shared hashes."""
    n = len(hashes)
    need = -(-num * n // den)
    counts = table[_slots(hashes)]
    order = np.argsort(counts, kind="stable")[: n - need + min(LONGEST, need)]  # equal counts: by hash
    ks = np.arange(1, min(LONGEST, need) + 1)
    met = np.cumsum(np.maximum(counts[order] - noise, 0.0))[n - need :]
    k = int(ks[np.argmin(n - need + ks + met * (1 + VERIFY * n / ks))])
    return k, hashes[order[: n - need + k]]


def marks(hashes: np.ndarray) -> np.ndarray:
    """``MARKS`` parity bits, each of the hashes that fall on it, as 64-bit words."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) & (MARKS - 1), minlength=MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(words: np.ndarray) -> np.ndarray:
    """The same for ``FOLD`` bits."""
    return np.bitwise_xor.reduce(words.reshape(-1, FOLD // 64), axis=0)


def _prefixes(docs: DataFrame, size: int, num: int, den: int, table: np.ndarray) -> DataFrame:
    """(low, t, n, f0, f1, k, marks, fold, first): prefix of every text that has words."""
    noise = float(table.mean(dtype=np.float64))
    noise += 3 * noise**0.5 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, sets in _sets(batches, size):
            at = [i for i, s in enumerate(sets) if len(s)]
            if not at:
                continue
            sets = [sets[i] for i in at]
            ks, firsts = zip(*(prefix(s, table, noise, num, den) for s in sets))
            odd = [marks(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(a).take(pa.array(at)) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int32()), *_prints(sets), pa.array(ks, pa.int32()),
                    blobs([m.tobytes() for m in odd]), list_column(np.concatenate([folded(m) for m in odd]), np.full(len(odd), FOLD // 64), pa.int64()),
                    list_column(np.concatenate(firsts).view(np.int64), [len(f) for f in firsts], pa.int64()),
                ],
                ["low", "t", "n", "f0", "f1", "k", "marks", "fold", "first"],
            )

    return docs.mapInArrow(run, "low long, t binary, n int, f0 long, f1 long, k int, marks binary, fold array<long>, first array<long>")


# Pairs ----------------------------------------------------------------------------------------


def _alike(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sizes and marks allow the threshold: (den + num) * differences <= (den - num) * (|a| + |b|)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(batch), -1) for i in (4, 5))
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok = ((den + num) * apart <= (den - num) * (na + nb)) & (den * np.minimum(na, nb) >= num * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok))

    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("marks").alias(f"m{c}")) for c in "ab")
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Pairs whose whole sets reach the threshold. A text b of many pairs has a copy for every ``SHARE`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, other = WordHashes(), None, None
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, ok = batch.slice(at, 256), []
                for b, ta, tb in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    if b != last:
                        last, other = b, np.unique(shingles(words.of(tb), size))
                    own = np.unique(shingles(words.of(ta), size))
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    ok.append(den * both >= num * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    many = F.ceil(F.count("*").over(Window.partitionBy("b")) / SHARE)
    dealt = pairs.withColumn("copy", F.pmod(F.xxhash64("a"), many).cast("int"))
    copies = dealt.select("b", "copy").distinct().join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    both = dealt.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(copies, ["b", "copy"])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _apart(rows: DataFrame) -> DataFrame:
    """Entries of hashes that lie in more than one component."""
    mixed = rows.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("h")
    return rows.join(mixed, "h", "left_semi")


def _star(rows: DataFrame, turn: int) -> DataFrame:
    """For each document the hub of another component with which it shares most prefix hashes.

    The first hub of a hash is the document with most shared ones among its own (of near copies, the one closest to
    all), later ones are other documents.
    """
    order = -F.col("typical") if turn == 0 else F.xxhash64("node", F.lit(turn))
    hubs = rows.groupBy("h").agg(F.min(F.struct(order.alias("o"), "node", "c")).alias("hub"))
    met = rows.join(hubs, "h").filter("c <> hub.c").groupBy("node", F.col("hub.node").alias("b")).agg(F.count("*").alias("m"))
    best = met.groupBy("node").agg(F.max(F.struct("m", "b")).alias("x"))
    return best.select(F.col("node").alias("a"), F.col("x.b").alias("b"))


def _met(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share as many prefix hashes as their prefixes ask for."""
    blocks = rows.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g"))
    own = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    placed = rows.join(blocks, "h").withColumn("own", own)
    # Blocks i <= j meet: a row stands on the left side for each j, on the right side for each i.
    mine = ("node", "n", "k", "c", "fold")
    left = placed.withColumn("other", F.explode(F.sequence("own", F.col("g") - 1))).select("h", F.col("own").alias("i"), F.col("other").alias("j"), *mine)
    right = placed.withColumn("other", F.explode(F.sequence(F.lit(0), "own")))
    right = right.select("h", F.col("other").alias("i"), F.col("own").alias("j"), *(F.col(x).alias(f"{x}_") for x in mine))
    apart = sum(F.bit_count(F.col("fold")[i].bitwiseXOR(F.col("fold_")[i])) for i in range(FOLD // 64))
    pairs = (
        left.join(right, ["h", "i", "j"]).filter("c <> c_ AND (i < j OR node < node_)")
        .filter(den * F.least("n", "n_") >= num * F.greatest("n", "n_")).filter((den + num) * apart <= (den - num) * (F.col("n") + F.col("n_")))
    )
    a, b = F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")
    return pairs.groupBy(a, b, F.least("k", "k_").alias("ask")).agg(F.count("*").alias("m")).filter("m >= ask").select("a", "b")


def ngram_join(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_classes): for each row the smallest id reachable by links, and the distinct sets there.

    Link: den * |A & B| >= num * |A | B| on sets of ``size``-word shingles. Texts without words (null or empty) have an
    empty set and no links. Rows of equal ids are documents of their own, linked by their texts only. Rows without id
    are not documents here and are left out.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "ngramjoin")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), bytes_of(F.col(f"`{text}`")).alias("t")).filter("doc_id IS NOT NULL")
    profiles = keep(_profiles(docs, size), folder, "profiles")
    made = profiles.filter("slice IS NULL").select("doc_id", "n", "f0", "f1")
    classes = made.filter("n > 0").groupBy("f0", "f1").agg(F.min("doc_id").alias("low"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()), folder, "classes")

    first = _prefixes(docs, size, num, den, _frequencies(profiles))
    nodes = first.join(classes, ["f0", "f1", "low"]).dropDuplicates(["f0", "f1", "low"]).select("node", "n", "k", "marks", "fold", "first", "t")
    nodes = keep(nodes, folder, "nodes", codec="zstd")
    entries = nodes.select(F.explode("first").alias("h"), "node").withColumn("m", F.count("*").over(Window.partitionBy("h")))
    shared = keep(entries.filter("m > 1").select("h", "node"), folder, "shared")
    typical = shared.groupBy("node").agg(F.count("*").alias("typical")).join(nodes.select("node", F.size("first").alias("of")), "node")
    rows = shared.join(typical.select("node", (F.col("typical") / F.col("of")).alias("typical"), F.col("node").alias("c")), "node")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        # Each table is written before it meets the texts: Spark sees its size, and moves it rather than them if it is small.
        alike = keep(_alike(keep(pairs, folder, f"met-{name}"), nodes, num, den), folder, f"alike-{name}")
        return keep(_linked(alike, nodes.select("node", "t"), size, num, den), folder, f"links-{name}")

    links, comp = None, None
    for turn in range(TURNS):
        found = confirmed(_star(rows, turn), str(turn))
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        comp = keep(components(links, folder, f"star-{turn}"), folder, f"comp-{turn}")
        rows = rows.drop("c").join(comp, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        rows = keep(_apart(rows), folder, f"entries-{turn + 1}")
    found = confirmed(_met(rows.join(nodes.select("node", "n", "k", "fold"), "node"), num, den), "rest")
    comp = components(found if links is None else links.union(found), folder, "all")

    of_node = classes.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    whole = of_node.groupBy("c").agg(F.min("low").alias("component_id"), F.count("*").alias("n_classes"))
    of_class = of_node.join(whole, "c").select("f0", "f1", "component_id", "n_classes")
    out = made.join(of_class, ["f0", "f1"], "left")
    linked = F.col("n") > 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_classes", F.lit(1)).alias("n_classes"),
    )
