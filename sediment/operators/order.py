"""Places in an order that no task holds alone: numbers and running sums over ranges of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written


def _ranged(rows: DataFrame, by: tuple[str, ...], order: str, label: str) -> DataFrame:
    """``rows`` with ``__part``: ascending ranges of (by, order), each about as large. They are written, as ranges drawn
    anew would differ."""
    ranged = rows.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id())
    return written(ranged, label)


def _before(ranged: DataFrame, by: tuple[str, ...], amount: Column) -> DataFrame:
    """What lies before each range inside its group: a row per range, not per row."""
    sums = ranged.groupBy(*by, "__part").agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).cast("long").alias("__before"))


def _placed(rows: DataFrame, by: tuple[str, ...], order: str, amount: Column, within: Column) -> DataFrame:
    ranged = _ranged(rows, by, order, "ranges")
    at = ranged.withColumn("__within", within)
    # Null groups are groups too, so the key that joins is compared null-safely.
    before = _before(ranged, by, amount).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), "__before")
    match = F.col("__part") == F.col("__of")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return at.join(before, match).drop("__of", *[f"__{c}" for c in by])


def numbered(rows: DataFrame, *by: str, order: str = "key", into: str = "rn") -> DataFrame:
    """The number of each row from 0 in its order, inside each group of ``by`` or, without one, in all. Rows of equal order
    are numbered in any way."""
    inside = Window.partitionBy(*by, "__part").orderBy(order)
    d = _placed(rows, by, order, F.lit(1), F.row_number().over(inside) - 1)
    return d.withColumn(into, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")


def running(rows: DataFrame, amount: str, *by: str, order: str, into: str) -> DataFrame:
    """The sum of ``amount`` over the rows before each row in its order, inside each group of ``by`` or in all."""
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    d = _placed(rows, by, order, F.col(amount), F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return d.withColumn(into, F.col("__before") + F.col("__within")).drop("__part", "__within", "__before")
