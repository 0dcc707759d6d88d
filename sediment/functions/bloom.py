"""Bloom filters as tables of set bits, on whole keys or on their prefixes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import cell

#: Filters of up to so many bits are broadcast to a probe; larger ones are joined by a shuffle.
BROADCAST_BITS = 10_000_000


#: A filter has fewer bits than the modulus of its hashes allows; more keys raise its rate of false answers.
MOST_BITS = (1 << 31) - 1
#: Bits of a word of a packed filter.
WORD = 32


def bits_for(n: int, rate: float) -> int:
    return min(math.ceil(max(n, 1) * abs(math.log(rate)) / math.log(2) ** 2), MOST_BITS)


def hashes_for(n: int, m: int) -> int:
    return math.ceil(m / max(n, 1) * math.log(2))


def _bits(key: Column, m: int | Column, k: int) -> Column:
    return F.array(*[cell(key, i, m) for i in range(k)])


def build(keys: DataFrame, m: int, k: int) -> DataFrame:
    """``bit`` rows of the filter of ``key`` rows."""
    return keys.select(F.explode(_bits(F.col("key"), m, k)).alias("bit")).distinct()


def merge(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.distinct()


def check(bits: DataFrame, probes: DataFrame, m: int, k: int) -> DataFrame:
    """``key, present`` for distinct ``key`` rows; a key that was added is always present."""
    asked = probes.select("key").distinct().select("key", F.explode(F.array_distinct(_bits(F.col("key"), m, k))).alias("bit"))
    table = bits.withColumn("hit", F.lit(1))
    table = F.broadcast(table) if m <= BROADCAST_BITS else table
    return asked.join(table, "bit", "left").groupBy("key").agg((F.count("hit") == F.count("*")).alias("present"))


def prefixes(keys: DataFrame, least: int, most: int, *by: str) -> DataFrame:
    """Distinct prefixes of ``least`` to ``most`` characters of ``key`` rows, in each group."""
    n = F.least(F.lit(most), F.length("key"))
    each = F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda i: F.substr("key", F.lit(1), i)))
    return keys.select(*by, F.explode(each).alias("key")).distinct()


def check_prefixes(bits: DataFrame, probes: DataFrame, m: int, k: int, least: int, most: int) -> DataFrame:
    """``key, present`` for prefixes: one shorter than ``least`` may always be there, a longer one is cut."""
    asked = probes.select(F.col("key").alias("probe")).distinct()
    cut = asked.select("probe", F.substring("probe", 1, most).alias("key"))
    found = check(bits, cut.where(F.length("probe") >= least), m, k)
    return cut.join(found, "key", "left").select(F.col("probe").alias("key"), F.when(F.length("probe") < least, F.lit(True)).otherwise(F.coalesce("present", F.lit(False))).alias("present"))


def packed(keys: DataFrame, rate: float, most: int, *by: str) -> DataFrame:
    """``by..., m, k, words``: a filter of the distinct ``key`` rows of each group, sized by their number, as an array of
    ``WORD``-bit numbers. Groups that would need more than ``most`` bits have none."""
    k = hashes_for(1_000_000, bits_for(1_000_000, rate))
    keys = keys.select(*by, "key").distinct()
    bits = F.greatest(F.ceil(F.col("n") * F.lit(abs(math.log(rate)) / math.log(2) ** 2)), F.lit(1)).cast("long")
    sized = keys.groupBy(*by).agg(F.count("*").alias("n")).select(*by, bits.alias("m")).where(F.col("m") <= most)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / WORD)))
    empty = sized.select(*by, "m", at.alias("w"), F.lit(0).cast("long").alias("v"))
    hit = keys.join(sized, list(by)).select(*by, "m", F.explode(_bits(F.col("key"), F.col("m"), k)).alias("bit"))
    hit = hit.groupBy(*by, "m", F.floor(F.col("bit") / WORD).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % WORD).cast("int"))).alias("v"))
    words = empty.unionByName(hit).groupBy(*by, "m", "w").agg(F.max("v").alias("v"))
    words = words.groupBy(*by, "m").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words"))
    return words.select(*by, F.col("m").cast("int").alias("m"), F.lit(k).alias("k"), "words")


def is_set(words: Column, bit: Column) -> Column:
    word = F.get(words, F.floor(bit / WORD).cast("int"))
    return F.call_function("shiftright", word, (bit % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1


def holds(words: Column, key: Column, m: int | Column, k: int) -> Column:
    """Whether a packed filter may hold a key."""
    out = F.lit(True)
    for i in range(k):
        out = out & is_set(words, cell(key, i, m))
    return out


def gate(filters: DataFrame, by: str, probes: DataFrame, k: int) -> DataFrame:
    """``by, key``: for each ``key`` of the probes the groups (runs) that may hold it. ``filters`` has a row per group: its
    ``min_key``, ``max_key`` and packed filter ``words`` of ``m`` bits and ``k`` hashes. Only groups whose bounds hold a probe test its bits, so
    a probe meets no run that its bounds rule out."""
    met = within_bounds(filters.select(by, "min_key", "max_key"), by, probes.select("key").distinct())
    tested = met.join(filters.select(by, "m", "words"), by)
    return tested.where(holds(F.col("words"), F.col("key"), F.col("m").cast("long"), k)).select(by, "key")


def within_bounds(bounds: DataFrame, by: str, probes: DataFrame) -> DataFrame:
    """``by, key``: each probe with the groups whose ``min_key`` to ``max_key`` hold it, as an equi-join on the stretches
    between neighbouring lower bounds. ``bounds`` has a row per group, of which the lower bounds travel as one array."""
    cuts = bounds.agg(F.array_sort(F.collect_set("min_key")).alias("__cuts"))
    last = lambda key: F.size(F.filter("__cuts", lambda c: c <= F.col(key)))
    groups = bounds.crossJoin(F.broadcast(cuts)).select(by, "min_key", "max_key", F.explode(F.sequence(last("min_key"), last("max_key"))).alias("__at"))
    asked = probes.crossJoin(F.broadcast(cuts)).select("key", last("key").alias("__at"))
    return asked.join(groups, "__at").where(F.col("key").between(F.col("min_key"), F.col("max_key"))).select(by, "key")
