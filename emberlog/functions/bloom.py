"""Bloom filters as rows (word, bits) of 64-bit words, built, tested, united and estimated by DataFrame functions."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def size_for(n: int, p: int) -> tuple[int, int]:
    """Words (a power of two) and lookups of a filter for n keys with a false positive in fewer than 1 of p tests."""
    wanted = int(0.0325 * math.log(p) * n)
    words = 1 << max(0, (wanted - 1).bit_length()) if wanted > 1 else 1
    return words, int(1.4 * math.log(p) + 1)


def _hashed(rows: DataFrame, key: str, words: int, lookups: int, *keep: str) -> DataFrame:
    """rows (keep..., bit), one for each lookup of a key; its hash is taken once."""
    digest = F.md5(F.col(key).cast("binary"))
    part = lambda at: F.conv(F.substring("_digest", at, 8), 16, 10).cast("long")
    halves = rows.select(*keep, digest.alias("_digest")).select(*keep, part(1).alias("_a"), part(9).alias("_b"))
    bits = F.array(*((F.col("_a") + i * F.col("_b")).bitwiseAND(F.lit(64 * words - 1)) for i in range(1, lookups + 1)))
    return halves.select(*keep, F.explode(bits).alias("bit"))


def positions_of(key: str, words: int, lookups: int) -> list[int]:
    """The bits of one key, as the columns have them."""
    digest = hashlib.md5(key.encode()).hexdigest()  # noqa: S324
    a, b = int(digest[:8], 16), int(digest[8:16], 16)
    return [(a + i * b) & (64 * words - 1) for i in range(1, lookups + 1)]


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def build(keys: DataFrame, words: int, lookups: int, key: str = "key", by: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    """(by..., word, bits) of the filter over a key column; null keys are left out. distinct: no key comes twice (for each by)."""
    keys = keys.where(F.col(key).isNotNull()).select(*by, key)
    # a hot key once, not its bits for each of its rows
    bits = _hashed(keys if distinct else keys.distinct(), key, words, lookups, *by)
    return bits.groupBy(*by, F.expr("bit div 64").alias("word")).agg(F.bit_or(_mask(F.col("bit"))).alias("bits"))


def test(probes: DataFrame, filters: DataFrame, words: int, lookups: int, key: str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., key, maybe) for every probe against the filters (each of them, with by): whether all its bits are set."""
    asked = _hashed(probes, key, words, lookups, key).withColumn("word", F.expr("bit div 64"))
    met = asked.join(filters, "word", "left")
    hits = met.groupBy(*by, key).agg(F.sum(F.when(F.col("bits").bitwiseAND(_mask(F.col("bit"))) != 0, 1).otherwise(0)).alias("n"))
    return hits.select(*by, key, (F.col("n") == lookups).alias("maybe"))


def union(a: DataFrame, b: DataFrame, words: tuple[int, int] | None = None) -> DataFrame:
    """The filter that holds the keys of both. Given the sizes of both in words, they must be equal."""
    if words is not None and words[0] != words[1]:
        raise ValueError(f"filters of {words[0]} and {words[1]} words can't be united")
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def estimate(filter_: DataFrame, words: int, lookups: int) -> DataFrame:
    """(bits_set, keys): how many keys the filter holds, about; keys is null if all bits are set, which tells no number."""
    set_ = F.sum(F.bit_count("bits")).cast("long")
    m = 64 * words
    unset = F.nullif(F.lit(m) - F.col("bits_set"), F.lit(0))
    return filter_.agg(set_.alias("bits_set")).select("bits_set", F.round(F.lit(m / lookups) * F.log(F.lit(float(m)) / unset)).cast("long").alias("keys"))
