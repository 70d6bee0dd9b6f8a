"""Operator 8, packing: optimal length buckets and token-budget batches.

The global histogram of lengths is summed up first. A dynamic programme chooses the ends of at most
``buckets`` buckets so that padding every text to the end of its bucket wastes the fewest tokens. Inside
a bucket, texts in order of (length, id) fill batches of as many rows as the token budget allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from webloom.llm.common import keep, work_folder

EXACT = 4096
STEPS = 256


def words_in(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text, null as 0."""
    t = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " +"))).cast("long")


def cell_end(length: Column) -> Column:
    """Length, rounded up above ``EXACT`` to one of ``STEPS`` ends for each doubling.

    This bounds the histogram by EXACT + STEPS * log2(longest / EXACT) cells, whatever the texts are.
    """
    step = F.pow(F.lit(2.0), F.ceil(F.log2(length / EXACT)) - 1) * (EXACT // STEPS)
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / step) * step)).cast("long")


def boundaries(ends: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ends of the buckets with the least padded tokens: sum over texts of the end of their bucket.

    ``ends`` ascending. The cost of a bucket satisfies the quadrangle inequality, so the best split moves
    one way and each layer is solved by halving: O(buckets * cells * log cells).
    """
    ends, total = np.asarray(ends, np.float64), np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    m = len(ends)
    if not m:
        return []
    best, back = ends * total[1:], []
    for _ in range(min(buckets, m) - 1):
        now, cut = best.copy(), np.full(m, -1)
        todo = [(0, m - 1, 0, m - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            i = (a + b) // 2
            js = np.arange(low, min(high, i - 1) + 1)
            at = low
            if len(js):
                cost = best[js] + ends[i] * (total[i + 1] - total[js + 1])
                k = int(cost.argmin())
                at = int(js[k])
                if cost[k] < now[i]:
                    now[i], cut[i] = cost[k], at
            todo += [(a, i - 1, low, at), (i + 1, b, at, high)]
        back.append(cut)
        best = now
    out, i = [int(ends[-1])], m - 1
    for cut in reversed(back):
        if cut[i] >= 0:
            i = int(cut[i])
            out.append(int(ends[i]))
    return out[::-1]


def pack(docs: DataFrame, length: Column, buckets: int = 16, budget: int = 16_384, key: str = "doc_id") -> DataFrame:
    """(doc_id, length, bucket, padded_length, batch, slot) for every row of ``docs``.

    ``padded_length`` is the end of the bucket, ``batch`` numbers the batches of a bucket from 0, ``slot``
    the rows of a batch. A batch holds max(1, budget // padded_length) rows, so only a text longer than the
    budget exceeds it, alone. Empty texts (length 0) have a bucket that costs nothing and batches of
    ``budget`` rows. Rows of equal ids are packed each; rows without id come first in their length.

    Ranks come from a range partitioning by (bucket, length, id): each row's place in its partition plus
    the rows of the same bucket in partitions before it. A bucket may hold any share of the rows.
    """
    spark = docs.sparkSession
    folder = work_folder(spark, "packing")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("k"), length.cast("long").alias("n"))
    rows = keep(rows.withColumn("cell", cell_end(F.col("n"))), folder, "lengths")
    cells = rows.groupBy("cell").agg(F.count("*").alias("c")).orderBy("cell").toPandas()
    used = cells[cells["cell"] > 0]
    ends = boundaries(used["cell"].to_numpy(), used["c"].to_numpy(), buckets)
    ends = ([0] if (cells["cell"] == 0).any() else []) + ends
    bucket = F.lit(None).cast("int")
    for i, end in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("cell") <= end, F.lit(i)).otherwise(bucket)
    size = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends] or [F.lit(0).cast("long")]), F.col("b") + 1)
    ranged = rows.withColumn("b", bucket).repartitionByRange("b", "n", "k").withColumn("p", F.spark_partition_id())
    ranged = keep(ranged.select("k", "n", "b", "p"), folder, "ranged")
    before = Window.partitionBy("b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("b", "p").agg(F.count("*").alias("c"))  # a row for each bucket and partition
    starts = parts.select("b", "p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("b", "p").orderBy("n", "k")) - 1
    ranked = ranged.withColumn("place", place).join(starts, ["b", "p"]).withColumn("rank", F.col("start") + F.col("place"))
    ranked = ranked.withColumn("end", size).withColumn("room", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("end"), F.lit(1)))))
    return ranked.select(
        F.col("k").alias(key), F.col("n").alias("length"), F.col("b").alias("bucket"), F.col("end").alias("padded_length"),
        F.floor(F.col("rank") / F.col("room")).cast("long").alias("batch"), F.pmod("rank", "room").cast("long").alias("slot"),
    )
