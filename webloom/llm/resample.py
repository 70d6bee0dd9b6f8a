"""Operator 11, importance resampling towards a target text set, with segments (lines) deduplicated.

Features are runs of one and two consecutive words, hashed into ``BUCKETS``. A newline separates words, so a text is
its lines one after another, and its features are those inside its lines plus one word pair across each line end. Lines
repeat within and across texts; therefore

* each distinct line is kept once with the number of its occurrences, its feature buckets are computed once, and enter
  the corpus counts times the occurrences; word pairs across line ends are counted separately, from the texts;
* the gain of a line is summed once and joined to the texts that have the line, times its occurrences there.

Hot lines: occurrences are added up inside tasks and again before the shuffle. In the join, lines that hold more than
1 / ``HOT`` of all occurrences (fewer than ``HOT`` lines, whatever the input) are broadcast, others go by key.

Lines are compared after normalisation (lower case, one space between words), by a 128-bit hash. Work tables hold
hashes of the lines of each text (20 bytes a line) and two bytes for each feature of each distinct line.

Nulls and empty texts have no words, no features and weight 0. A row without id is scored without noise: its score and
rank are null, and it is not counted among the documents to draw from. Rows of a repeated id are documents of their own
with the same noise; equal scores of one id are ranked in the order of the rows read. Ids in the target texts are not used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import blobs, bytes_of, keep, list_column, ranked, texts_of, work_folder

BUCKETS = 10_000
HOT = 4096
RUN = 1 << 22
#: Bytes of words (0-9, a-z, all of a character beyond ASCII) stay, A-Z go to lower case, newlines stay, others become a space.
WORD_BYTES = bytes(ord("\n") if b == 10 else b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def lines_of(text: bytes) -> list[list[bytes]]:
    """Words of each line that has any."""
    return [w for w in map(bytes.split, text.translate(WORD_BYTES).split(b"\n")) if w]


def _key(line: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(line)


def _longs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)


class Buckets:
    """Feature buckets of lines, whole runs of lines at a time: each distinct word and word pair is hashed once a run."""

    def of(self, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all lines, features of each line)."""
        split = [line.split(b" ") for line in lines]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers: dict[bytes, int] = {}
        at = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int64, int(counts.sum()))
        words = list(numbers)
        single = np.fromiter(map(crc32, words), np.uint32, len(words))
        opened = [crc32(b" ", c) for c in single.tolist()]
        ends = np.cumsum(counts)
        inside = np.ones(len(at), bool)
        inside[ends - 1] = False  # the last word of a line starts no pair in it
        start = np.flatnonzero(inside)
        pairs, back = np.unique(at[start] * len(words) + at[start + 1], return_inverse=True)
        first, second = np.divmod(pairs, len(words))
        double = np.fromiter((crc32(words[b], opened[a]) for a, b in zip(first.tolist(), second.tolist())), np.uint32, len(pairs))
        out = np.empty(2 * len(at), np.uint32)
        out[0::2] = single[at]
        valid = np.ones(2 * len(at), bool)
        valid[2 * (ends - 1) + 1] = False
        out[2 * start + 1] = double[back]
        return (out[valid] % BUCKETS).astype(np.uint16), 2 * counts - 1


def _occurrences(texts: DataFrame) -> DataFrame:
    """(k0, k1, times, line): lines of the texts, added up within runs of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in texts_of(batch.column(0), RUN):
                seen = Counter(b" ".join(words) for text in part for words in lines_of(text))
                k = _longs([_key(line) for line in seen])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(list(seen.values()), pa.int64()), blobs(list(seen))], ["k0", "k1", "times", "line"]
                )

    return texts.mapInArrow(run, "k0 long, k1 long, times long, line binary")


def segments(texts: DataFrame) -> DataFrame:
    """(k0, k1, times, buckets): distinct lines of a binary column with their occurrences and their feature buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Buckets()
        for batch in batches:
            for a, part in texts_of(batch.column(3), RUN):
                found, counts = make.of(part)
                ends = np.concatenate(([0], np.cumsum(counts)))
                cut = [found[i:j].tobytes() for i, j in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, len(part)) for i in range(3)), blobs(cut)], ["k0", "k1", "times", "buckets"])

    whole = _occurrences(texts).groupBy("k0", "k1").agg(F.sum("times").alias("times"), F.any_value("line").alias("line"))
    return whole.mapInArrow(run, "k0 long, k1 long, times long, buckets binary")


def _outlines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, k0, k1, times, across): distinct lines of each text, buckets of the pairs across its line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in texts_of(batch.column(1), RUN):
                words, keys, times, sizes, across = [], [], [], [], []
                for text in part:
                    lines = lines_of(text)
                    seen = Counter(b" ".join(line) for line in lines)
                    words.append(sum(map(len, lines)))
                    keys += [_key(line) for line in seen]
                    times += seen.values()
                    sizes.append(len(seen))
                    pairs = [crc32(y[0], crc32(b" ", crc32(x[-1]))) % BUCKETS for x, y in zip(lines, lines[1:])]
                    across.append(np.array(pairs, np.uint16).tobytes())
                k = _longs(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(part)), pa.array(words, pa.int64()), list_column(k[:, 0], sizes, pa.int64()),
                        list_column(k[:, 1], sizes, pa.int64()), list_column(np.array(times, np.int32), sizes, pa.int32()), blobs(across),
                    ],
                    ["doc_id", "n_words", "k0", "k1", "times", "across"],
                )

    return docs.mapInArrow(run, "doc_id long, n_words long, k0 array<long>, k1 array<long>, times array<int>, across binary")


def _histogram(rows: DataFrame) -> DataFrame:
    """(bucket, n) of rows (times, buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            times = batch.column(0).to_numpy(zero_copy_only=False)
            parts = [np.frombuffer(b, np.uint16) for b in batch.column(1).to_pylist()]
            if parts:
                np.add.at(total, np.concatenate(parts), np.repeat(times, [len(p) for p in parts]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return rows.select(F.col("times").cast("long"), "buckets").mapInArrow(run, "bucket int, n long")


def _counts(lines: DataFrame, outlines: DataFrame) -> np.ndarray:
    """Features in each bucket; ``BUCKETS`` numbers come to the driver."""
    across = outlines.select(F.lit(1).alias("times"), F.col("across").alias("buckets"))
    out = np.zeros(BUCKETS, np.int64)
    for r in _histogram(lines).union(_histogram(across)).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the smoothed log ratio of target to corpus, for each bucket."""
    whole, wanted = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * wanted))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def _gain_of(rows: DataFrame, column: str, gain: np.ndarray, into: str) -> DataFrame:
    """Sum of the gains of a column of buckets, in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain[np.frombuffer(b, np.uint16)].sum()) for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *batch.columns[at + 1 :], pa.array(sums, pa.int64())], names)

    rest = [f for f in rows.schema.fields if f.name != column]
    at, names = rows.columns.index(column), [f.name for f in rest] + [into]
    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{into}` long"]))


def noise(seed: int, key: Column) -> Column:
    """Gumbel noise in whole thousandths, from the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least: int = 20, text: str = "text", key: str = "doc_id", target_text: str = "text"
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the draw, without replacement, of ``percent`` of the texts with ``least`` words.

    weight: floored mean gain of a text's features; score: weight plus Gumbel noise; rank: 1, 2, 3 … of the drawn, else null.
    """
    folder = work_folder(docs.sparkSession, "resample")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), bytes_of(F.col(f"`{text}`")).alias("t"))
    goal = target.select(F.lit(None).cast("long").alias("doc_id"), bytes_of(F.col(f"`{target_text}`")).alias("t"))

    lines = keep(segments(docs.select("t")), folder, "lines")
    outlines = keep(_outlines(docs).withColumn("row", F.monotonically_increasing_id()), folder, "outlines")
    gain = gains(_counts(lines, outlines), _counts(segments(goal.select("t")), _outlines(goal)))

    worth = keep(_gain_of(lines, "buckets", gain, "gain"), folder, "worth")
    total = worth.agg(F.sum("times")).first()[0] or 0
    frequent = (F.col("times") * HOT > total).alias("frequent")
    hot = F.broadcast(worth.filter(frequent).select("k0", "k1", "gain"))  # fewer than HOT rows: each has more than 1 / HOT of all
    cold = worth.filter(~frequent).select("k0", "k1", "gain")
    uses = outlines.select("row", F.inline(F.arrays_zip("k0", "k1", "times")))
    met = uses.join(hot, ["k0", "k1"]).unionByName(uses.join(hot.select("k0", "k1"), ["k0", "k1"], "left_anti").join(cold, ["k0", "k1"]))
    inside = met.groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("inside"))

    each = _gain_of(outlines.select("row", "doc_id", "n_words", "across"), "across", gain, "between")
    n, all_ = F.greatest(2 * F.col("n_words") - 1, F.lit(0)), F.coalesce("inside", F.lit(0)) + F.col("between")
    weight = F.when(n > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = each.join(inside, "row", "left").select("row", "doc_id", "n_words", n.alias("n_features"), all_.alias("sum"))
    scored = scored.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    scored = keep(scored.drop("sum"), folder, "scored")

    able = scored.filter((F.col("n_words") >= least) & F.col("score").isNotNull())
    drawn = percent * able.count() // 100
    order = ranked(able.select("row", "doc_id", "score"), [F.desc("score"), F.asc("doc_id"), F.asc("row")], folder, "order", "rank")
    out = scored.join(order.filter(F.col("rank") <= drawn).select("row", "rank"), "row", "left")
    return out.select("doc_id", "n_features", "weight", "score", "rank")
