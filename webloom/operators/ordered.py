"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here a key with many rows is cut into chunks
of about equally many rows along its order (``equal_chunks``): the window runs per (key, chunk), one small summary
row per chunk is scanned per key, and its result is joined back. Tasks are bounded by the chunk, not by the key,
however unevenly the rows lie in time. Keys below that size, often all of them, are one chunk.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import cut_lineage

CHUNK = "_chunk"
CHUNK_ROWS = 500_000


def time_chunk(us: Column, seconds: int) -> Column:
    """Chunk number of an epoch-microsecond value."""
    return F.floor(us / F.lit(seconds * 1_000_000)).cast("bigint")


def fitting_chunk_seconds(df: DataFrame, keys: list[str], us: str, rows: int = 500_000, base: int = 60) -> int:
    """Chunk length at which the busiest key keeps about ``rows`` rows per chunk.

    One aggregation over counts per key and minute; only its maximum comes to the driver.
    """
    per_slot = df.groupBy(*keys, F.floor(F.col(us) / F.lit(base * 1_000_000))).agg(F.count(F.lit(1)).alias("n"))
    busiest = per_slot.agg(F.max("n")).first()[0] or 1
    return max(1, base * rows // busiest)


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def equal_chunks(df: DataFrame, keys: list[str], at: str, rows: int | None = None) -> tuple[DataFrame, bool]:
    """(rows with their chunk number, whether any key is cut): chunks of about ``rows`` rows of a key along its whole number ``at``.

    The ends of the chunks are quantiles of ``at``, taken from mergeable summaries of each key. Only keys with more
    than ``rows`` rows have any, so there are fewer ends than twice the rows of the table over ``rows``, and they are
    broadcast. Rows of one key and one ``at`` stay together.
    """
    rows = rows or CHUNK_ROWS
    largest = largest_key(df, keys)
    if largest <= rows:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint")), False
    parts = math.ceil(largest / rows)
    quantiles = F.percentile_approx(at, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))
    ends = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), quantiles.alias("_q")).filter(F.col("_n") > rows)
    own = F.ceil(F.col("_n") / rows).cast("int")  # this key's number of chunks
    cut = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.element_at("_q", F.least(F.lit(parts - 1), F.ceil(i * parts / own).cast("int"))))
    # Searched in two steps: the last ends of groups of about equal size first, then the ends of one group.
    step = F.ceil(F.sqrt(F.size("_ends"))).cast("int")
    firsts = F.transform(F.sequence(F.lit(0), F.floor((F.size("_ends") - 1) / F.col("_step")).cast("int")), lambda g: F.get("_ends", g * F.col("_step")))
    ends = ends.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.array_sort(F.array_distinct(cut)).alias("_ends"))
    ends = ends.withColumn("_step", step).withColumn("_firsts", firsts)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    group = F.size(F.filter("_firsts", lambda e: e < F.col(at))) - 1
    inside = F.slice("_ends", F.greatest(group, F.lit(0)) * F.col("_step") + 1, F.col("_step"))
    chunk = F.when(group < 0, 0).otherwise(group * F.col("_step") + F.size(F.filter(inside, lambda e: e < F.col(at))))
    return df.join(F.broadcast(ends), same, "left").withColumn(CHUNK, F.coalesce(chunk, F.lit(0)).cast("bigint")).select(*df.columns, CHUNK), True


def _chunked(df: DataFrame, keys: list[str], order: list[str], chunk: Column | None, rows: int | None) -> tuple[DataFrame, bool]:
    return equal_chunks(df, keys, order[0], rows) if chunk is None else (df.withColumn(CHUNK, chunk), True)


def _per_chunk(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _over_chunks(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK)


def _attach(rows: DataFrame, summary: DataFrame, keys: list[str], many: bool) -> DataFrame:
    """Rows with the summary of their chunk, NULL where no key is cut; NULL is a key like any other."""
    if not many:
        return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in summary.schema if f.name not in (*keys, CHUNK)})
    side = summary.withColumnsRenamed({c: f"_of_{c}" for c in (*keys, CHUNK)})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return rows.join(side, [*same, F.col(CHUNK) == F.col(f"_of_{CHUNK}")], "left").drop(*[f"_of_{c}" for c in (*keys, CHUNK)])


def trailing_sums(df: DataFrame, keys: list[str], us: str, width_us: int, sums: dict[str, Column], rows: int | None = None) -> DataFrame:
    """Adds sums over (us - width, us] per key, rows of equal time included.

    Each row enters the running sum at its time and leaves it one width later, so the cost per row does not depend on
    how many rows the window holds, and a chunk needs nothing of the rows before it but their sum. Sums must be of
    whole numbers: they are added and taken away again.
    """

    def event(when: Column, sign: int, row: bool) -> Column:
        return F.struct(when.alias("t"), F.lit(sign).cast("bigint").alias("s"), F.lit(row).alias("row"))

    own = list(df.columns)
    cells = df.select(*own, *[v.cast("bigint").alias(f"_v_{k}") for k, v in sums.items()])
    cells = cells.withColumn("_e", F.explode(F.array(event(F.col(us), 1, True), event(F.col(us) + F.lit(width_us), -1, False))))
    # Columns of rows that only leave are not needed, so they are not shuffled.
    slim = cells.select(
        *keys, F.col("_e.t").alias("_t"), F.col("_e.row").alias("_row"), *[(F.col(f"_v_{k}") * F.col("_e.s")).alias(f"_v_{k}") for k in sums],
        *[F.when(F.col("_e.row"), F.col(c)).alias(c) for c in own if c not in keys],
    )
    slim, many = equal_chunks(slim, keys, "_t", rows)
    before = _over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.groupBy(*keys, CHUNK).agg(*[F.sum(f"_v_{k}").alias(f"_v_{k}") for k in sums])
    carry = totals.select(*keys, CHUNK, *[F.sum(f"_v_{k}").over(before).alias(f"_c_{k}") for k in sums]).filter(F.col(CHUNK) > 0)
    w = _per_chunk(keys, ["_t"]).rangeBetween(Window.unboundedPreceding, 0)
    local = slim.select("*", *[F.sum(f"_v_{k}").over(w).alias(f"_s_{k}") for k in sums]).filter("_row")
    return _attach(local, carry, keys, many).select(*own, *[(F.col(f"_s_{k}") + F.coalesce(f"_c_{k}", F.lit(0))).alias(k) for k in sums])


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], chunk: Column | None = None, rows: int | None = None
) -> DataFrame:
    """Adds values of the row before, per key and across chunks (W7, W12, W13): ``{new: old}``."""
    packed = F.struct(*[F.col(old).alias(new) for new, old in cols.items()])
    placed, many = _chunked(df, keys, order, chunk, rows)
    heads = placed.groupBy(*keys, CHUNK).agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carry = heads.select(*keys, CHUNK, F.lag("_last").over(_over_chunks(keys)).alias("_carry"))
    w = _per_chunk(keys, order)
    local = placed.select(
        "*", F.lag(packed).over(w).alias("_prev"), (F.row_number().over(w) == 1).alias("_first")
    )
    before = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    return (
        _attach(local, carry, keys, many)
        .withColumn("_before", before)
        .select(*df.columns, *[F.col(f"_before.{new}").alias(new) for new in cols])
    )


def running_count(df: DataFrame, keys: list[str], order: list[str], name: str, chunk: Column | None = None, rows: int | None = None) -> DataFrame:
    """Adds the 1-based position of a row in its key."""
    placed, many = _chunked(df, keys, order, chunk, rows)
    sizes = placed.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(_over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*keys, CHUNK, before.alias("_off"))
    local = placed.withColumn("_i", F.row_number().over(_per_chunk(keys, order)))
    return _attach(local, offsets, keys, many).select(
        *df.columns, (F.col("_i") + F.coalesce("_off", F.lit(0))).alias(name)
    )


def running_max_before(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, chunk: Column | None = None, rows: int | None = None
) -> DataFrame:
    """Adds the largest value of all earlier rows of the key; NULL for the first one."""
    placed, many = _chunked(df, keys, order, chunk, rows)
    tops = placed.groupBy(*keys, CHUNK).agg(F.max(value).alias("_m"))
    carry = tops.select(
        *keys, CHUNK, F.max("_m").over(_over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry")
    )
    w = _per_chunk(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.max(value).over(w))
    return _attach(local, carry, keys, many).select(
        *df.columns, F.greatest(F.col("_local"), F.col("_carry")).alias(name)
    )


def failure_runs(df: DataFrame, keys: list[str], order: list[str], ok: Column, name: str, chunk: Column | None = None, rows: int | None = None) -> DataFrame:
    """Adds the number of failures in a row up to and including each row; 0 on success."""
    w = _per_chunk(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    placed, many = _chunked(df, keys, order, chunk, rows)
    local = (
        placed.withColumn("_ok", ok)
        .withColumn("_i", F.row_number().over(w))
        .withColumn("_last_ok", F.max(F.when(F.col("_ok"), F.col("_i"))).over(upto))
    )
    ends = local.groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_last_ok").alias("_ok_at")
    )
    tail = F.col("_n") - F.coalesce("_ok_at", F.lit(0))
    over = _over_chunks(keys)
    total = F.sum("_tail").over(over)
    opened = F.coalesce(F.max(F.when(F.col("_ok_at").isNotNull(), F.col("_cum") - F.col("_tail"))).over(over), F.lit(0))
    carry = (
        ends.withColumn("_tail", tail)
        .withColumn("_cum", total)
        .withColumn("_out", F.col("_cum") - opened)
        .select(*keys, CHUNK, F.coalesce(F.lag("_out").over(over), F.lit(0)).alias("_in"))
    )
    run = F.when(F.col("_last_ok").isNull(), F.col("_i") + F.coalesce("_in", F.lit(0))).otherwise(F.col("_i") - F.col("_last_ok"))
    return _attach(local, carry, keys, many).select(*df.columns, run.cast("bigint").alias(name))


def next_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, rows: int | None = None) -> DataFrame:
    """Adds the smallest value of the key's later rows, NULL values left out; for values that grow along the order."""
    placed, many = _chunked(df, keys, order, None, rows)
    later = Window.partitionBy(*keys).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy(*keys, CHUNK).agg(F.min(value).alias("_m"))
    carry = heads.select(*keys, CHUNK, F.min("_m").over(later).alias("_carry"))
    w = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.min(value).over(w))
    return _attach(local, carry, keys, many).select(*df.columns, F.coalesce("_local", "_carry").alias(name))


SCAN_BLOCK = 256


def composed_clamps(df: DataFrame, keys: list[str], at: str, largest: int, block: int | None = None) -> DataFrame:
    """Prefix composition of the maps x -> min(hi, max(lo, x * m)) along ``at`` = 1, 2, 3 … ``largest`` of each key, in m, lo, hi.

    Two such maps one after the other are a third one. Blocks of ``block`` rows are scanned by doubling: after the
    round of 2**k, a row holds the composition of the 2**(k + 1) maps up to it. The last rows of the blocks are scanned
    alike and put before the rows of the next block, so no task holds more than a block, whatever the key.
    """
    block = block or SCAN_BLOCK
    placed = df.withColumn("_b", F.floor((F.col(at) - 1) / block).cast("bigint"))
    # The rounds cost more than their bytes tell: the blocks are dealt to all partitions, however few bytes they are.
    placed = placed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_b")
    w = Window.partitionBy(*keys, "_b").orderBy(at)
    for k in range((min(block, max(largest, 1)) - 1).bit_length()):
        placed = _after(placed.select("*", F.lag(F.struct("m", "lo", "hi"), 1 << k).over(w).alias("_p")))
    if largest <= block:
        return placed.drop("_b")
    placed = cut_lineage(placed)  # read twice below
    ends = placed.groupBy(*keys, "_b").agg(F.max_by(F.struct("m", "lo", "hi"), F.col(at)).alias("_e"))
    ends = ends.select(*keys, (F.col("_b") + 1).alias("_at"), "_e.*")
    before = composed_clamps(ends, keys, "_at", math.ceil(largest / block), block)
    before = before.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_at").alias("_of_b"), F.struct("m", "lo", "hi").alias("_p"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = placed.join(before, [*same, F.col("_b") == F.col("_of_b")], "left")
    return _after(joined).select(*df.columns)


def _after(df: DataFrame) -> DataFrame:
    """The map of each row after the map ``_p``, if there is one. A map of one value keeps the factor 1, so none overflows."""
    p, none = F.col("_p"), F.col("_p").isNull()
    lo, hi = (F.least(F.col("hi"), F.greatest(F.col("lo"), p[x] * F.col("m"))) for x in ("lo", "hi"))
    m = F.when(lo >= hi, 1.0).otherwise(p["m"] * F.col("m"))
    new = {c: F.when(none, F.col(c)).otherwise(v).alias(c) for c, v in (("m", m), ("lo", lo), ("hi", hi))}
    return df.select(*[new.get(c, F.col(c)) for c in df.columns if c != "_p"])
