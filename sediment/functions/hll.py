"""HyperLogLog as a table of registers ``idx, rank``: exact, mergeable, and equal however the rows are split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import md5_bits


def precision(error: float) -> int:
    p = math.ceil(math.log2((1.04 / error) ** 2))
    if not 4 <= p <= 16:
        raise ValueError("the precision must lie in 4..16")
    return p


def registers(df: DataFrame, item: Column, p: int) -> DataFrame:
    h = md5_bits(item.cast("string"))
    w = F.shiftleft("h", p).bitwiseOR(F.lit(1 << (p - 1)))
    r = df.where(item.isNotNull()).select(h.alias("h")).select(F.shiftrightunsigned("h", 64 - p).cast("int").alias("idx"), (65 - F.length(F.bin(w))).cast("int").alias("rank"))
    return r.groupBy("idx").agg(F.max("rank").alias("rank"))


def merge(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("idx").agg(F.max("rank").alias("rank"))


def alpha(m: int) -> float:
    # The bias corrections of the published estimator.
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def estimate(registers: DataFrame, p: int) -> DataFrame:
    """One row ``estimate``: raw, by linear counting if small, corrected if near 2^32; truncated."""
    m = 1 << p
    big = float(1 << 32)
    a = registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count("*").alias("n"))
    a = a.select((F.lit(alpha(m) * m * m) / (F.col("s") + (m - F.col("n")))).alias("raw"), (m - F.col("n")).alias("zeros"))
    small = (F.col("raw") <= 2.5 * m) & (F.col("zeros") > 0)
    out = F.when(small, m * F.log(F.lit(float(m)) / F.col("zeros"))).when(F.col("raw") > big / 30, -big * F.log1p(-F.col("raw") / big)).otherwise(F.col("raw"))
    return a.select(F.floor(out).cast("long").alias("estimate"))
