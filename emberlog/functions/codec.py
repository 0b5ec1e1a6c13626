"""Codecs: counters as four little-endian bytes, entry sizes, and 128-bit Murmur3 where its exact bits are wanted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


def encode_counter(n: Column) -> Column:
    """Four little-endian bytes of a count, modulo 2 ** 32."""
    text = F.lpad(F.hex(F.pmod(n, F.lit(1 << 32))), 8, "0")
    return F.unhex(F.concat(*(F.substring(text, k, 2) for k in (7, 5, 3, 1))))


def decode_counter(data: Column) -> Column:
    """The count in four little-endian bytes; null for any other length."""
    text = F.hex(data)
    order = F.concat(*(F.substring(text, k, 2) for k in (7, 5, 3, 1)))
    return F.when(F.octet_length(data) == 4, F.conv(order, 16, 10).cast("long"))


def entry_bytes(key: Column, value: Column) -> Column:
    """Bytes of a stored entry: two lengths, a flag, key and value in UTF-8."""
    return (F.lit(9) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def _mixed(x: int) -> int:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor & _MASK
    return x ^ x >> 33


def murmur3_128(data: bytes) -> tuple[int, int]:
    """Murmur3 for 64-bit machines, 128 bits, seed 0 (public domain algorithm)."""
    factors = (0x87C37B91114253D5, 0x4CF5AD432745937F)
    turn = lambda x, r: (x << r | x >> 64 - r) & _MASK
    scramble = lambda x, k: turn(x * factors[k] & _MASK, (31, 33)[k]) * factors[1 - k] & _MASK
    h, whole = [0, 0], len(data) // 16 * 16
    for at in range(0, whole, 16):
        for k, (r, add) in enumerate(((27, 0x52DCE729), (31, 0x38495AB5))):
            h[k] ^= scramble(int.from_bytes(data[at + 8 * k : at + 8 * k + 8], "little"), k)
            h[k] = ((turn(h[k], r) + h[1 - k]) * 5 + add) & _MASK
    for k in (0, 1):
        h[k] ^= scramble(int.from_bytes(data[whole + 8 * k : whole + 8 * k + 8], "little"), k) ^ len(data)
    h[0] = (h[0] + h[1]) & _MASK
    h[1] = (h[1] + h[0]) & _MASK
    h = [_mixed(x) for x in h]
    h[0] = (h[0] + h[1]) & _MASK
    return h[0], (h[1] + h[0]) & _MASK


def murmur3_hex(text: Column) -> Column:
    """Both halves in hexadecimal, for tests against other implementations; not used by the filters."""

    @F.pandas_udf("string")
    def hexed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "%016x%016x" % murmur3_128(x.encode()))

    return hexed(text)
