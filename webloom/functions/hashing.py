"""Hashes for shards and Bloom positions. 64-bit values are kept as two 32-bit limbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import let

# FNV offset bases and primes (32 bit; 64 bit as high and low limb).
_FNV32_BASIS, _FNV32_PRIME = 2166136261, 16777619
_FNV64_HI, _FNV64_LO = 3421674724, 2216829733
_FNV64_PRIME_LOW = 435  # the 64-bit prime is 2^40 + 435
_MASK32 = 4294967295
_TWO64 = "18446744073709551616"
# Fixed value: stands in for a second hash of zero.
_ZERO_H2 = "11400714819323198485"


def _bytes(s: Column) -> Column:
    """UTF-8 bytes of a string as ARRAY<BIGINT>."""
    hexed = F.hex(F.encode(s, "UTF-8"))
    return F.when(s == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.octet_length(s), F.lit(1))),
            lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"),
        )
    )


def fnv1a_32(s: Column) -> Column:
    mask = F.lit(_MASK32)
    return F.aggregate(
        _bytes(s),
        F.lit(_FNV32_BASIS).cast("bigint"),
        lambda h, b: (h.bitwiseXOR(b) * F.lit(_FNV32_PRIME)).bitwiseAND(mask),
    )


def affinity_shard(host: Column, workers: int) -> Column:
    """Worker bucket of a host."""
    if workers <= 1:
        return F.lit(0).cast("bigint")
    return fnv1a_32(F.lower(host)) % F.lit(workers).cast("bigint")


def _times_prime(hi: Column, lo: Column) -> Column:
    mask, prime = F.lit(_MASK32).cast("bigint"), F.lit(_FNV64_PRIME_LOW).cast("bigint")
    low = lo * prime
    carry = F.shiftrightunsigned(low, 32)
    high = (hi * prime + carry + F.shiftleft(lo, 8)).bitwiseAND(mask)
    return F.struct(high.alias("hi"), low.bitwiseAND(mask).alias("lo"))


def fnv64(s: Column, xor_first: bool) -> Column:
    """FNV-1a 64 (xor first) or FNV-1 64 (multiply first) as DECIMAL(20,0)."""
    start = F.struct(F.lit(_FNV64_HI).cast("bigint").alias("hi"), F.lit(_FNV64_LO).cast("bigint").alias("lo"))

    def step(acc: Column, b: Column) -> Column:
        if xor_first:
            return _times_prime(acc["hi"], acc["lo"].bitwiseXOR(b))
        return let(
            _times_prime(acc["hi"], acc["lo"]),
            lambda t: F.struct(t["hi"].alias("hi"), t["lo"].bitwiseXOR(b).alias("lo")),
        )

    two32 = F.lit(2**32).cast("decimal(11,0)")
    return let(
        F.aggregate(_bytes(s), start, step),
        lambda a: (a["hi"].cast("decimal(10,0)") * two32 + a["lo"].cast("decimal(10,0)")).cast("decimal(20,0)"),
    )


def fnv_pair(s: Column) -> Column:
    """The two hashes of an item in parity mode."""
    h2 = let(fnv64(s, False), lambda h: F.when(h == 0, F.lit(_ZERO_H2).cast("decimal(20,0)")).otherwise(h))
    return F.struct(fnv64(s, True).alias("h1"), h2.alias("h2"))


def md5_pair(s: Column) -> Column:
    """Two 32-bit hashes that any SQL engine can recompute from md5."""
    digest = F.md5(s)
    return F.struct(
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").alias("h1"),
        F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint").alias("h2"),
    )


def xx_pair(s: Column) -> Column:
    """Two 31-bit hashes from xxhash64: one native call per hash, the default at scale."""
    low = F.lit(0x7FFFFFFF).cast("bigint")
    return F.struct(
        F.xxhash64(F.lit(17), s).bitwiseAND(low).alias("h1"), F.xxhash64(F.lit(71), s).bitwiseAND(low).alias("h2")
    )


HASHERS = {"xx": xx_pair, "md5": md5_pair, "fnv": fnv_pair}


def bloom_positions(s: Column, m: int, k: int, hasher: str = "xx") -> Column:
    """ARRAY<BIGINT> of the k bit positions (h1 + i*h2) mod m, with 64-bit wrap in parity mode."""
    pair = HASHERS[hasher]

    def at(p: Column, i: Column) -> Column:
        if hasher != "fnv":
            return (p["h1"] + i.cast("bigint") * p["h2"]) % F.lit(m).cast("bigint")
        total = p["h1"].cast("decimal(30,0)") + i.cast("decimal(4,0)") * p["h2"].cast("decimal(20,0)")
        return ((total % F.lit(_TWO64).cast("decimal(20,0)")) % F.lit(m).cast("decimal(20,0)")).cast("bigint")

    return let(pair(s), lambda p: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: at(p, i)))
