import math

from pyspark.sql import functions as F

from webloom.functions import clock, hashing, text
from webloom.operators import dedup


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_price(spark):
    cases = [("¥1,299", "1", "CNY"), ("now $ 12.5 or €3", "12.5", "USD"), ("12 .5 a", "12.5", ""), ("£3", "3", "GBP")]
    for raw, amount, currency in cases:
        got = one(spark, text.price_amount(F.lit(raw)), text.price_currency(F.lit(raw)))
        assert got == (amount, currency)


def test_text(spark):
    assert one(spark, text.normalize_text(F.lit(" a \n\t b　"))) == ("a b",)
    assert one(spark, text.first_non_empty(F.lit(" "), F.lit(" x  y"), F.lit("z"))) == ("x y",)
    assert one(spark, text.first_non_empty(F.lit(" "))) == ("",)
    assert one(spark, text.head_bytes(F.lit("aé"), 2)) == ("a�",)


def test_clock(spark):
    t = clock.parse_time(F.lit("2026-08-22 23:10:03"))
    assert one(spark, clock.format_wall(t), F.hour(t)) == ("2026-08-22 23:10:03", 23)
    zoned = clock.parse_time(F.lit("2026-08-22T15:10:03Z"))
    assert one(spark, clock.format_wall(zoned), clock.to_unix(zoned)) == ("2026-08-22 23:10:03", 1787411403)
    assert one(spark, clock.format_wall(clock.parse_time(F.lit("soon")))) == ("",)
    assert one(spark, clock.format_wall(clock.from_unix(F.lit(1787411403)))) == ("2026-08-22 23:10:03",)


def test_backoff_and_tone(spark):
    waits = [one(spark, text.backoff_ms(F.lit(a)))[0] for a in (-1, 0, 3, 6, 9)]
    assert waits == [200.0, 200.0, 1600.0, 8000.0, 8000.0]
    assert [one(spark, text.fail_tone(F.lit(r)))[0] for r in (0.2, 0.06, 0.01, 7.0)] == ["bad", "warn", "ok", "warn"]


def test_stats_maps(spark):
    a, b = F.create_map(F.lit("x"), F.lit(1).cast("bigint")), F.create_map(F.lit("y"), F.lit(2).cast("bigint"))
    assert one(spark, text.add_stats(a, b)) == ({"x": 1, "y": 2},)
    m = F.create_map(F.lit("n"), F.lit("3.9"))
    assert one(spark, text.json_long(m, "n"), text.json_long(text.json_add(m, "n", F.lit(2)), "n")) == (3, 5)


def _fnv64(data: bytes, xor_first: bool) -> int:
    h = 0xCBF29CE484222325
    for byte in data:
        h = ((h ^ byte) * 0x100000001B3) % 2**64 if xor_first else ((h * 0x100000001B3) % 2**64) ^ byte
    return h


def test_bloom_positions_match_64_bit_hashes(spark):
    for word in ("hello", "für", ""):
        h1, h2 = _fnv64(word.encode(), True), _fnv64(word.encode(), False)
        pair, places = one(spark, hashing.fnv_pair(F.lit(word)), hashing.bloom_positions(F.lit(word), dedup.DEFAULT_M, 7, "fnv"))
        assert (int(pair.h1), int(pair.h2)) == (h1, h2)
        assert places == [((h1 + i * h2) % 2**64) % dedup.DEFAULT_M for i in range(7)]


def test_bloom_sizing(spark):
    m, k = one(spark, dedup.optimal_m(10_000_000, 0.01), dedup.optimal_k(dedup.DEFAULT_M, 10_000_000))
    assert 90_000_000 <= m <= 100_000_000 and k == 7
    assert one(spark, dedup.optimal_m(0, 5.0))[0] == math.ceil(-math.log(0.01) / math.log(2) ** 2)


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    n = 8000
    m = math.ceil(-n * math.log(0.01) / math.log(2) ** 2)
    url = F.concat(F.lit("https://shop.test/item/"), F.col("id").cast("string"))
    seen = spark.range(n).select(F.lit(1).alias("task_id"), url.alias("url"))
    other = spark.range(n).select(F.lit(1).alias("task_id"), F.concat(url, F.lit("/other")).alias("url"))
    bloom = dedup.build_bloom(seen, m, 7, "fnv").cache()
    hits = dedup.maybe_seen(seen.union(other), bloom, m, 7, "fnv").groupBy(F.col("url").endswith("/other")).agg(
        F.count_if("seen"), F.count("*")
    )
    got = {r[0]: (r[1], r[2]) for r in hits.collect()}
    assert got[False] == (n, n)
    assert got[True][0] / n <= 0.03
    stats = dedup.bloom_stats(bloom, m, 7).first()
    assert abs(stats.est_items - n) / n < 0.05
    fresh = dedup.fresh_urls_by_bloom(seen.union(other), seen, m, 7, "fnv")
    assert fresh.count() == n and fresh.filter(~F.col("url").endswith("/other")).count() == 0


def test_blank_urls_count_as_seen(spark):
    offers = spark.createDataFrame([(1, " "), (1, "a")], "task_id int, url string")
    none = offers.limit(0)
    got = dedup.maybe_seen(offers, dedup.build_bloom(none, 64, 2), 64, 2)
    assert {(r.url, r.seen) for r in got.collect()} == {("", True), ("a", False)}
    assert [r.url for r in dedup.fresh_urls_by_bloom(offers, none, 64, 2).collect()] == ["a"]
