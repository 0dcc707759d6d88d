"""The write-ahead log: record codec, segments, replay, truncation, in built-in expressions.

A record is crc32 u32 | seconds i64 | tombstone u8 | key bytes u64 | value bytes u64 | key | value, little-endian; the
checksum covers all after itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import computed_once
from ..operators.order import running
from ..operators.view import view
from ..schema import DELETE, PUT

HEAD = 4 + 8 + 1 + 8 + 8


def little_endian(n: Column, size: int) -> Column:
    """Hex of an integer's lowest bytes, lowest first."""
    n = n.cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])


def from_little_endian(data: Column) -> Column:
    """The unsigned number in up to seven, or the signed one in eight bytes of a binary column's hex."""
    size = 8
    pairs = [F.substring(F.rpad(data, 2 * size, "0"), 2 * i + 1, 2) for i in reversed(range(size))]
    return F.conv(F.concat(*pairs), 16, -10).cast("long")


def payload() -> Column:
    """Hex of a record without its checksum."""
    key, value = F.col("key").cast("binary"), F.coalesce("value", F.lit("")).cast("binary")
    return F.concat(
        little_endian(F.coalesce("ts", F.lit(0)), 8), F.when(F.col("op") == DELETE, "01").otherwise("00"),
        little_endian(F.octet_length(key), 8), little_endian(F.octet_length(value), 8), F.hex(key), F.hex(value),
    )


def encode(log: DataFrame) -> DataFrame:
    """``seq, user, record``: one binary record per mutation."""
    body = F.unhex(F.col("__body"))
    rows = log.select("seq", "user", payload().alias("__body"))
    return computed_once(rows.select("seq", "user", F.concat(F.unhex(little_endian(F.crc32(body), 4)), body).alias("record")))


def decode(records: DataFrame) -> DataFrame:
    """MUTATION rows and ``valid``: whether checksum and lengths hold."""
    r = F.col("record")
    part = lambda at, n: F.hex(F.substring(r, at, n))
    d = records.select(
        "seq", "user", "record", from_little_endian(part(1, 4)).alias("crc"), from_little_endian(part(5, 8)).alias("ts"), part(13, 1).alias("flag"),
        from_little_endian(part(14, 8)).alias("klen"), from_little_endian(part(22, 8)).alias("vlen"),
    )
    whole = (F.octet_length("record") == HEAD + F.col("klen") + F.col("vlen")) & (F.octet_length("record") >= HEAD)
    size = F.octet_length("record")
    rest = F.substr(F.col("record"), F.lit(5), size)
    k, v = F.least("klen", F.lit(1 << 30)).cast("int"), F.least("vlen", F.lit(1 << 30)).cast("int")
    return computed_once(d.select(
        "seq", "ts", "user",
        F.when(F.col("flag") == "01", DELETE).otherwise(PUT).alias("op"),
        F.substr(F.col("record"), F.lit(HEAD + 1), k).cast("string").alias("key"),
        F.substr(F.col("record"), F.lit(HEAD + 1) + k, v).cast("string").alias("value"),
        F.coalesce(whole & (F.crc32(rest) == F.col("crc")), F.lit(False)).alias("valid"),
    ))


def replay(records: DataFrame) -> DataFrame:
    """The live view that the valid records restore; a DELETE stays a deletion."""
    return view(decode(records).where("valid"))


def segments(log: DataFrame, size: int, *by: str) -> DataFrame:
    """``user, seq, bytes, segment``: the log's records in order, or those of each group of ``by`` (such as the user), a new
    segment with every ``size`` bytes before. The bytes before a record are summed by ranges, so no task holds the log."""
    n = (F.lit(HEAD) + F.octet_length("key") + F.octet_length(F.coalesce("value", F.lit("")))).cast("long")
    rows = running(log.select("user", "seq", n.alias("bytes")), "bytes", *by, order="seq", into="before")
    return rows.select("user", "seq", "bytes", F.floor(F.col("before") / size).cast("long").alias("segment"))


def truncate(log: DataFrame, flushed_seq: int) -> DataFrame:
    """What is left of the log once all up to ``flushed_seq`` is in a run."""
    return log.where(F.col("seq") > flushed_seq)
