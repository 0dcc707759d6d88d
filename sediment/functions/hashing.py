"""Hashes that sketches share: the first 64 bits of MD5, big-endian, with or without a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: row i's seed is (i + 1) times this, modulo 2^32, as four big-endian bytes.
GOLDEN = 0x9E3779B9


def seed_hex(i: int) -> str:
    return f"{(i + 1) * GOLDEN % (1 << 32):08x}"


def md5_bits(x: Column) -> Column:
    """The 64 bits as a signed BIGINT."""
    return F.conv(F.substring(F.md5(x), 1, 16), 16, -10).cast("long")


def seeded_hex(x: Column, i: int) -> Column:
    """16 hex digits of the hash of the bytes of x and row i's seed."""
    return F.substring(F.md5(F.concat(x.cast("string").cast("binary"), F.unhex(F.lit(seed_hex(i))))), 1, 16)


def hex_modulo(digits: Column, m: int | Column) -> Column:
    """An unsigned 64-bit number in hex modulo m < 2^31, in 64-bit arithmetic; m may be a column."""
    if isinstance(m, int) and not 0 < m < 1 << 31:
        raise ValueError(f"a modulus of {m} is not below 2^31")
    m = F.lit(m).cast("long") if isinstance(m, int) else m
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return ((high % m) * (F.lit(1 << 32) % m) + low % m) % m


def cell(x: Column, i: int, m: int | Column) -> Column:
    return hex_modulo(seeded_hex(x, i), m)
