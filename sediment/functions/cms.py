"""Count-Min sketch as a table of cells ``row, col, n``: mergeable by adding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import cell


def width(epsilon: float) -> int:
    return math.ceil(math.e / epsilon)


def depth(delta: float) -> int:
    return math.ceil(math.log(1 / delta))


def _cells(item: Column, w: int, d: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("row"), cell(item, i, w).cast("int").alias("col")) for i in range(d)]))


def cells(df: DataFrame, item: Column, epsilon: float, delta: float) -> DataFrame:
    """Items are counted first, so each distinct one is hashed once and hot ones aren't multiplied."""
    counted = df.where(item.isNotNull()).groupBy(item.cast("string").alias("item")).agg(F.count("*").alias("n"))
    c = counted.select("n", _cells(F.col("item"), width(epsilon), depth(delta)).alias("c"))
    return c.groupBy("c.row", "c.col").agg(F.sum("n").alias("n"))


def merge(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("row", "col").agg(F.sum("n").alias("n"))


def estimate(sketch: DataFrame, items: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """``item, estimate`` for distinct ``item`` rows; never below the true count. The sketch has at most width x depth
    cells, a bound that its parameters fix, and is broadcast under a million."""
    w, d = width(epsilon), depth(delta)
    asked = items.select("item").distinct().select("item", _cells(F.col("item"), w, d).alias("c")).select("item", "c.*")
    table = F.broadcast(sketch) if w * d <= 1_000_000 else sketch
    found = asked.join(table, ["row", "col"], "left")
    return found.groupBy("item").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
