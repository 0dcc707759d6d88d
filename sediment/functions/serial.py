"""Sketches as bytes and back: one BINARY value per sketch, for exchange with other programs.

    HyperLogLog   precision u8 | registers u32 | a byte per register
    Count-Min     "CMS1" | version u8 (1) | width u32 | depth u32 | cells u64, row by row
    Bloom         hashes u32 | bits u32 | a byte per bit | seeds u32 each
    SimHash       u64

All big-endian. Sizes are those that a sketch's parameters fix, so a value is bounded whatever was counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import seed_hex


def _hex(n: Column, size: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def _dense(table: DataFrame, at: Column, value: Column, size: int, width: int) -> Column | DataFrame:
    """One row ``body``: hex of ``size`` values in order, absent ones 0."""
    places = table.sparkSession.range(size).select(F.col("id").alias("__at"))
    given = table.select(at.cast("long").alias("__at"), value.cast("long").alias("__v"))
    full = places.join(given, "__at", "left").select("__at", _hex(F.coalesce("__v", F.lit(0)), width).alias("__h"))
    return full.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__h"))), lambda x: x["__h"]), "").alias("body"))


def _number(data: Column, at: int | Column, size: int) -> Column:
    start = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substr(data, start.cast("int"), F.lit(size))), 16, -10).cast("long")


def hll_bytes(registers: DataFrame, p: int) -> DataFrame:
    body = _dense(registers, F.col("idx"), F.col("rank"), 1 << p, 1)
    return body.select(F.unhex(F.concat(_hex(F.lit(p), 1), _hex(F.lit(1 << p), 4), F.col("body"))).alias("sketch"))


def hll_registers(sketches: DataFrame) -> DataFrame:
    """``idx, rank`` of the union of all ``sketch`` values."""
    d = sketches.select("sketch", F.explode(F.sequence(F.lit(0), (_number(F.col("sketch"), 2, 4) - 1).cast("int"))).alias("idx"))
    d = d.select("idx", _number(F.col("sketch"), F.col("idx") + 6, 1).cast("int").alias("rank")).where("rank > 0")
    return d.groupBy("idx").agg(F.max("rank").alias("rank"))


def cms_bytes(cells: DataFrame, w: int, d: int) -> DataFrame:
    body = _dense(cells, F.col("row") * w + F.col("col"), F.col("n"), w * d, 8)
    head = F.concat(F.hex(F.lit("CMS1")), _hex(F.lit(1), 1), _hex(F.lit(w), 4), _hex(F.lit(d), 4))
    return body.select(F.unhex(F.concat(head, F.col("body"))).alias("sketch"))


def cms_cells(sketches: DataFrame) -> DataFrame:
    """``row, col, n`` of the sum of all ``sketch`` values; other values are an error."""
    s = F.col("sketch")
    known = F.when(F.hex(F.substr(s, F.lit(1), F.lit(5))) == F.concat(F.hex(F.lit("CMS1")), F.lit("01")), _number(s, 6, 4)).otherwise(F.raise_error(F.lit("not a Count-Min sketch")).cast("long"))
    d = sketches.select("sketch", known.alias("w"), _number(s, 10, 4).alias("d"))
    d = d.select("sketch", "w", F.explode(F.sequence(F.lit(0), (F.col("w") * F.col("d") - 1).cast("int"))).alias("i"))
    d = d.select(F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), (F.col("i") % F.col("w")).cast("int").alias("col"), _number(F.col("sketch"), F.col("i") * 8 + 14, 8).alias("n"))
    return d.where("n > 0").groupBy("row", "col").agg(F.sum("n").alias("n"))


def bloom_bytes(bits: DataFrame, m: int, k: int) -> DataFrame:
    body = _dense(bits, F.col("bit"), F.lit(1), m, 1)
    seeds = "".join(seed_hex(i) for i in range(k))
    return body.select(F.unhex(F.concat(_hex(F.lit(k), 4), _hex(F.lit(m), 4), F.col("body"), F.lit(seeds))).alias("sketch"))


def bloom_bits(sketches: DataFrame) -> DataFrame:
    """``bit`` of the union of all ``sketch`` values."""
    d = sketches.select("sketch", F.explode(F.sequence(F.lit(0), (_number(F.col("sketch"), 5, 4) - 1).cast("int"))).alias("bit"))
    return d.where(_number(F.col("sketch"), F.col("bit") + 9, 1) > 0).select("bit").distinct()


def simhash_bytes(h: Column) -> Column:
    return F.unhex(_hex(h, 8))


def simhash_of(data: Column) -> Column:
    return F.conv(F.hex(data), 16, -10).cast("long")
