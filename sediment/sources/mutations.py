"""Mutation logs from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETE, PUT


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
    return day + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def log_of(df: DataFrame, key: Column, value: Column, seq: Column, deleted: Column | None = None, user: Column | None = None, ts: Column | None = None, **more: Column) -> DataFrame:
    """Rows of MUTATION, and ``more`` columns; a DELETE has an empty value."""
    deleted = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    return df.select(
        seq.cast("long").alias("seq"),
        (F.lit(None).cast("long") if ts is None else ts).alias("ts"),
        (F.lit(None) if user is None else user).cast("string").alias("user"),
        F.when(deleted, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("op"),
        key.cast("string").alias("key"),
        F.when(deleted, F.lit("")).otherwise(value.cast("string")).alias("value"),
        *[c.alias(k) for k, c in more.items()],
    )


def _padded(user: str = "user_id") -> Column:
    return F.lpad(F.col(user).cast("string"), 6, "0")


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key ``type:user``, value the event's id; the log is ordered by time."""
    e = read(spark, sf_dir, "events")
    at = micros(F.col("ts"))
    return log_of(e, F.concat("event_type", F.lit(":"), _padded()), F.col("event_id"), at, user=F.col("user_id"), ts=F.floor(at / 1_000_000).cast("long"))


def user_log(events: DataFrame) -> DataFrame:
    """Key ``user:id``; an error event deletes. Of a table or a stream of events."""
    at = micros(F.col("ts"))
    return log_of(
        events, F.concat(F.lit("user:"), _padded()), F.col("event_id"), at, F.col("event_type") == "error", F.col("user_id"), F.floor(at / 1_000_000).cast("long")
    )


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_log(read(spark, sf_dir, "events"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log by type, every fifth event a DELETE, dealt into eight runs on two levels."""
    e = read(spark, sf_dir, "events")
    run = F.col("event_id") % 8
    return log_of(
        e, F.concat("event_type", F.lit(":"), _padded()), F.col("event_id"), micros(F.col("ts")), F.col("event_id") % 5 == 0,
        run_id=run.cast("int"), level=F.floor(run / 4).cast("int"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(read(spark, sf_dir, "customer"), F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that repeat; the greatest part number holds."""
    return log_of(read(spark, sf_dir, "part"), F.col("p_name"), F.col("p_brand"), F.col("p_partkey"))
