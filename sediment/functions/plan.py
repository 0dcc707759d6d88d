"""Shaping plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, with what stands above never merged into the projections below.

    Filters and projections over costly expressions are otherwise written out in their terms, once for each mention.
    A row is exploded into itself, which no rule reaches across.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)])
    return df.select(F.explode(F.array(row)).alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(df.columns)])


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as the session has cores.

    For work that is heavy per row over a scan of one small file, which is one task. A scan with more partitions, as of
    any large table, is left as it is and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
