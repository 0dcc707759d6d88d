"""Reads of a mutation log: the latest version of each key, and what is asked of it.

One rule decides everywhere: of a key's mutations the one with the greatest ``seq`` holds. A predicate on the key
may be applied before that (and is pushed into the scan), one on the value or the operation only after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DELETE


def latest(log: DataFrame) -> DataFrame:
    """``key, op, value, seq`` of the newest mutation of each key. Versions are combined before the shuffle, so
    a key with any number of them sends one row per task."""
    newest = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("v"))
    return newest.select("key", "v.op", "v.value", "v.seq")


def live(versions: DataFrame) -> DataFrame:
    """``key, value`` without deleted keys."""
    return versions.where(F.col("op") != DELETE).select("key", "value")


def view(log: DataFrame, include_tombstones: bool = False) -> DataFrame:
    newest = latest(log)
    return newest.select("key", "op", "value") if include_tombstones else live(newest)


def get(log: DataFrame, key: str) -> DataFrame:
    return view(log.where(F.col("key") == key))


def multi_get(log: DataFrame, keys: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """The live rows of the given ``key`` rows. The list of keys filters the log before versions are compared;
    it is broadcast only if it is small."""
    wanted = keys.select("key").distinct()
    few = F.broadcast(wanted) if wanted.limit(broadcast_rows + 1).count() <= broadcast_rows else wanted
    return view(log.join(few, "key", "left_semi"))


def prefix(log: DataFrame, start: str, include_tombstones: bool = False) -> DataFrame:
    """Keys that begin with ``start``; the empty prefix is every key."""
    return view(log.where(F.col("key").startswith(start)) if start else log, include_tombstones)


def key_range(log: DataFrame, low: str, high: str, include_tombstones: bool = False) -> DataFrame:
    """Keys from ``low`` to ``high``, both included; none if low is above high."""
    return view(log.where(F.col("key").between(low, high)), include_tombstones)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """The page ``number`` (from 1) of ``size`` rows by key; beyond the end it is empty."""
    if number < 1 or size < 0:
        raise ValueError("a page number starts at 1 and a size at 0")
    return rows.orderBy("key").offset((number - 1) * size).limit(size)


def steps(rows: DataFrame) -> DataFrame:
    """An iterator's steps as rows: ``key, value, has_next``, has_next being false on the last row.

    Only the greatest key is the last one, so it is found by an aggregate and no row is sorted."""
    last = rows.agg(F.max("key").alias("__last"))
    return rows.crossJoin(F.broadcast(last)).select("key", "value", (F.col("key") < F.col("__last")).alias("has_next"))


def tiers(newer: DataFrame, older: DataFrame) -> DataFrame:
    """A newer tier over an older one: what the newer knows masks the older, deletions included."""
    top, below = latest(newer), latest(older)
    return live(top.unionByName(below.join(top.select("key"), "key", "left_anti")))

