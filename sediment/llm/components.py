"""Connected components of an edge table, as alternating large and small stars.

Every step is an aggregate and a join, so no component is gathered anywhere; each round is written to
the shared folder, so that a lost executor costs one round at most. Hot nodes are pre-aggregated before
the shuffle, and their join may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.select("m", "u")).where("a <> b").distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for each node with an edge in ``a, b``; a component is its smallest node."""
    e = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state = _state(e)
    while state[0]:
        old, e = e, written(_small_star(_large_star(e)), "edges")
        discard(old)
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a"), F.col("a")).distinct())
