"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shared import discard, settled, written  # noqa: F401

#: Characters that separate words: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The array of words of a text; empty for a text without words."""
    return F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside send rows to Python in batches of at most ``rows``, which bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def unit_interval(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the parts: 32 bits of their MD5, over 2^32."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: What a Python worker is sent at once: so many rows, and about so many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python in batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes.
    Plans read these settings when they run, so they can't be set for one frame; smaller settings are left alone."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, most)


def through_python(docs: DataFrame, column: str, kind: str, run: Callable, result: str, more: str = "") -> tuple[DataFrame, list[str]]:
    """``docs`` with ``value`` of type ``result`` in place of ``column``, which ``run`` gets, cast to ``kind``, as the first
    column of its batches; ``more`` declares further columns that ``run`` adds at the end. The other columns are carried
    as ``c0, c1, ...``; their names are returned."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != column]
    inner = docs.select(F.col(f"`{column}`").cast(kind).alias("value"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    fields = [*StructType.fromDDL(f"value {result}").fields, *inner.schema.fields[1:], *(StructType.fromDDL(more).fields if more else [])]
    return inner.mapInArrow(run, StructType(fields)), others


def carried(others: list[str], *outputs: str) -> list[Column]:
    """The carried columns under their names, but those that ``outputs`` replace."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(others) if c not in outputs]
