"""Seen-URL handling: exact sets, Bloom bitmaps, and the bitmap as a filter in front of the exact join."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.hashing import bloom_positions
from webloom.functions.text import trim_space

# Bitmap size and hash count for 10 million URLs at 1 % false positives.
DEFAULT_M, DEFAULT_K = 95_850_583, 7


def optimal_m(n: Column | int, p: float) -> Column:
    """Bits for n items at false-positive rate p."""
    rate = p if 0 < p < 1 else 0.01
    items = F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(1)).cast("double")
    return F.ceil(-items * F.lit(math.log(rate)) / F.lit(math.log(2) ** 2)).cast("bigint")


def optimal_k(m: Column | int, n: Column | int) -> Column:
    """Number of hash functions, within 1..16."""
    bits = (F.lit(m) if isinstance(m, int) else m).cast("double")
    items = F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(1)).cast("double")
    k = F.floor(bits / items * F.lit(math.log(2)) + F.lit(0.5))
    return F.greatest(F.lit(1), F.least(F.lit(16), k)).cast("int")


def bloom_sizing(offers: DataFrame, p: float = 0.01) -> DataFrame:
    """Bitmap size and hash count for the distinct URLs of each task."""
    n = distinct_urls(offers).groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("m", optimal_m(F.col("n"), p)).withColumn("k", optimal_k(F.col("m"), F.col("n")))


def distinct_urls(offers: DataFrame) -> DataFrame:
    """Distinct URLs of each task (U1). Duplicates are dropped before the shuffle as well as after."""
    return offers.select("task_id", "url").distinct()


def fresh_urls(offers: DataFrame, seen: DataFrame) -> DataFrame:
    """Offered URLs that their task has not seen (J2). The key is (task, URL), so no task is hot."""
    return distinct_urls(offers).join(seen.select("task_id", "url"), ["task_id", "url"], "left_anti")


def offer_counts(offers: DataFrame, seen: DataFrame) -> DataFrame:
    """Offered, enqueued and duplicated URLs per task."""
    per_url = offers.groupBy("task_id", "url").agg(F.count(F.lit(1)).alias("n"))
    known = seen.select("task_id", "url", F.lit(True).alias("known")).distinct()
    marked = per_url.join(known, ["task_id", "url"], "left")
    enqueued = F.count_if(F.col("known").isNull())
    return marked.groupBy("task_id").agg(
        F.sum("n").alias("offered"), enqueued.alias("enqueued"), (F.sum("n") - enqueued).alias("duplicated")
    )


# Bloom ----------------------------------------------------------------------------------------


def _bit_rows(df: DataFrame, m: int, k: int, hasher: str) -> DataFrame:
    return df.withColumn("_p", F.explode(bloom_positions(F.col("url"), m, k, hasher)))


def build_bloom(urls: DataFrame, m: int = DEFAULT_M, k: int = DEFAULT_K, hasher: str = "xx") -> DataFrame:
    """Bitmap of each task in pieces of 32768 bits: task_id, bucket, bits.

    Positions are brought together by (task, bucket) before bitmaps are built: a partial bitmap per
    map task would send 4 KiB for a handful of bits. The key spreads even one single task over all
    of its buckets. Blank URLs are never added.
    """
    clean = distinct_urls(urls.select("task_id", trim_space(F.col("url")).alias("url"))).filter(F.col("url") != "")
    return (
        _bit_rows(clean, m, k, hasher)
        .select("task_id", F.bitmap_bucket_number("_p").alias("bucket"), F.bitmap_bit_position("_p").alias("_bit"))
        .repartition("task_id", "bucket")
        .groupBy("task_id", "bucket")
        .agg(F.bitmap_construct_agg("_bit").alias("bits"))
    )


def _bit_set(bits: Column, position: Column) -> Column:
    at = F.bitmap_bit_position(position)
    byte = F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)))
    # The digit of the half byte that holds the bit, then the bit of the digit.
    low = at.bitwiseAND(F.lit(4)) == 0
    digit = F.when(low, F.substring(byte, 2, 1)).otherwise(F.substring(byte, 1, 1))
    value = F.instr(F.lit("0123456789ABCDEF"), digit) - 1
    return F.get(F.lit([1, 2, 4, 8]), at.bitwiseAND(F.lit(3)).cast("int")).bitwiseAND(value) != 0


def maybe_seen(
    offers: DataFrame, bloom: DataFrame, m: int = DEFAULT_M, k: int = DEFAULT_K, hasher: str = "xx"
) -> DataFrame:
    """Distinct offered URLs with ``seen`` = all k bits set (J3); a blank URL counts as seen.

    The probes meet the bitmap on (task, bucket), a key that spreads even one single task.
    """
    urls = distinct_urls(offers.select("task_id", trim_space(F.col("url")).alias("url")))
    probes = _bit_rows(urls, m, k, hasher).withColumn("bucket", F.bitmap_bucket_number("_p"))
    met = probes.join(bloom, ["task_id", "bucket"], "left")
    hit = F.coalesce(_bit_set(F.col("bits"), F.col("_p")), F.lit(False))
    return met.groupBy("task_id", "url").agg(((F.col("url") == "") | F.bool_and(hit)).alias("seen"))


def fresh_urls_by_bloom(
    offers: DataFrame, seen: DataFrame, m: int = DEFAULT_M, k: int = DEFAULT_K, hasher: str = "xx"
) -> DataFrame:
    """Exact fresh URLs, with the bitmap in front (J3): only its positives are joined exactly."""
    # Blank URLs go first, so that both halves share one probe of the bitmap.
    some = offers.filter(trim_space(F.col("url")) != "")
    tested = maybe_seen(some, build_bloom(seen, m, k, hasher), m, k, hasher)
    sure = tested.filter(~F.col("seen")).select("task_id", "url")
    unsure = tested.filter(F.col("seen")).select("task_id", "url")
    return sure.unionByName(unsure.join(seen.select("task_id", "url"), ["task_id", "url"], "left_anti"))


def bloom_stats(bloom: DataFrame, m: int = DEFAULT_M, k: int = DEFAULT_K) -> DataFrame:
    """Set bits, fill, estimated items and false-positive rate of each task's bitmap."""
    fill = F.col("set_bits") / F.lit(float(m))
    items = F.when((fill > 0) & (fill < 1), -F.lit(float(m)) / F.lit(float(k)) * F.ln(1 - fill)).otherwise(0.0)
    return (
        bloom.groupBy("task_id")
        .agg(F.sum(F.bitmap_count("bits")).alias("set_bits"))
        .withColumns({"fill_ratio": fill, "est_items": items, "est_fp_rate": false_positive_rate(fill, k)})
    )


def false_positive_rate(fill: Column, k: int) -> Column:
    return F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fill)), F.lit(float(k)))
