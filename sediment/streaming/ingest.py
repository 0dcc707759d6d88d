"""Structured Streaming: a log ingested in micro-batches, and the token bucket as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from ..operators.limiter import admit
from ..operators.runs import flush


def into_runs(stream: DataFrame, base: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each micro-batch of a mutation stream as one run of level 0. The run is named by the batch, so a batch
    that is run again replaces its run; ``seq`` decides between versions, not the time of arrival."""

    def sink(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            flush(batch, base, 0, f"batch-{number:012d}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


DECISION = StructType([StructField("user", StringType()), StructField("seq", LongType()), StructField("allowed", BooleanType()), StructField("tokens", LongType())])


class TokenBuckets(StatefulProcessor):
    """One bucket per user: a state of two numbers, however long the stream."""

    def __init__(self, capacity: int, rate: float, strict: bool = False):
        self.capacity, self.rate, self.strict = capacity, rate, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", StructType([StructField("tokens", LongType()), StructField("t0", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("seq")
        tokens, t0 = self.bucket.get() if self.bucket.exists() else (self.capacity, int(asked["ts"].iloc[0]))
        out = []
        for seq, ts in zip(asked["seq"], asked["ts"]):
            (tokens, t0), (ok, _) = admit(tokens, t0, int(ts), self.capacity, self.rate, self.strict)
            out.append((key[0], int(seq), ok, tokens))
        self.bucket.update((tokens, t0))
        yield pd.DataFrame(out, columns=["user", "seq", "allowed", "tokens"])

    def close(self) -> None:
        pass


def limited(stream: DataFrame, capacity: int, rate: float, strict: bool = False) -> DataFrame:
    """Decisions for a stream of ``user, seq, ts`` (seconds); needs the RocksDB state store."""
    return stream.groupBy("user").transformWithStateInPandas(TokenBuckets(capacity, rate, strict), DECISION, "Append", "None")
