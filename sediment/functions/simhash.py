"""SimHash of token sets and pairs within a Hamming distance."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import md5_bits

#: 64 bits in six blocks; two hashes that differ in at most three bits agree on at least three blocks.
_BLOCKS = (11, 11, 11, 11, 10, 10)
MOST = 3


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))


def simhash(docs: DataFrame, key: str, features: Column) -> DataFrame:
    """``key, hash`` (BIGINT bits): a bit is set if more features, repeats included, have it than not; without features
    it is 0. Partial sums are formed where the features are, so a row per key and task is shuffled.

    Bits i and i + 32 are counted in the two halves of one number, which makes 32 sums of 64.
    """
    rows = docs.select(key, F.explode_outer(features).alias("f")).select(key, md5_bits(F.col("f")).alias("h"))
    pair = F.lit((1 << 32) | 1)
    sums = rows.groupBy(key).agg(F.count("h").alias("n"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair)).alias(f"c{i}") for i in range(32)])
    low = [F.col(f"c{i}").bitwiseAND(F.lit((1 << 32) - 1)) for i in range(32)]
    counts = low + [F.shiftrightunsigned(f"c{i}", 32) for i in range(32)]
    bits = [F.when(2 * c > F.col("n"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i, c in enumerate(counts)]
    return sums.select(key, F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("hash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def compare(a: Column, b: Column, threshold: int) -> Column:
    if not 0 <= threshold <= 64:
        raise ValueError("a threshold lies in 0..64")
    return hamming(a, b) <= threshold


def hex16(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def _masks() -> list[int]:
    at, blocks = 0, []
    for n in _BLOCKS:
        blocks.append(((1 << n) - 1) << at)
        at += n
    masks = [sum(c) for c in combinations(blocks, len(_BLOCKS) - MOST)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def classes(hashes: DataFrame, key: str) -> DataFrame:
    """One row per hash: ``hash, rep`` (its smallest key), ``n``."""
    return hashes.groupBy("hash").agg(F.min(key).alias("rep"), F.count("*").alias("n"))


def near_pairs(hashes: DataFrame, threshold: int = MOST) -> DataFrame:
    """Pairs ``a, b, distance`` (a < b) of distinct hashes (``hash, rep``) at a distance of at most ``threshold`` <= 3.

    No pair is missed: each meets in one of twenty equi-joins on 31 to 33 of the 64 bits. Equal hashes are one row
    here, so copies are never paired. Distinct hashes that share a block differ in the other 31 to 33 bits alone, so of n
    hashes spread evenly n^2 / 2^32 pairs at most meet there by chance; a family of many distinct hashes about one value
    meets as often as it has members that agree on the block, most of which are results.
    """
    if not 0 <= threshold <= MOST:
        raise ValueError(f"a threshold lies in 0..{MOST}")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("hash").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks())]))
    keyed = hashes.select("rep", "hash", keys.alias("c")).select("rep", "hash", "c.*")
    a, b = keyed.toDF("a", "ha", "t", "k"), keyed.toDF("b", "hb", "t", "k")
    pairs = a.join(b, ["t", "k"]).where((F.col("a") < F.col("b")) & (hamming(F.col("ha"), F.col("hb")) <= threshold))
    return pairs.select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance")).distinct()


def links(hashes: DataFrame, key: str, threshold: int = MOST) -> DataFrame:
    """Each document with its class (the smallest key of its hash) and how many others are within the threshold."""
    c = classes(hashes, key)
    p = near_pairs(c, threshold).select("a", "b")
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(c.select(F.col("rep").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    c = c.join(near.withColumnRenamed("a", "rep"), "rep", "left")
    return hashes.join(c, "hash").select(key, F.col("rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
