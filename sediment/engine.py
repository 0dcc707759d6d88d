"""A store in a folder: a mutation log, sorted runs, reads over both."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compact as compaction
from .operators import runs as R
from .operators import view as V
from .operators.cursor import Cursor
from .operators.limiter import Limiter
from .schema import DELETE, MUTATION, PUT, KVConfig


class RateLimited(RuntimeError):
    """A user is out of tokens."""


class Engine:
    """One writer, many readers. Bulk writes take a frame; single ones are buffered and appended to the log as a
    Parquet file when the buffer is full, on flush and on close, so opening a folder again recovers what was logged.

    ``flush`` turns the log into a run and then drops it; ``compact`` merges runs. Both come by themselves: once the rows
    that ``put`` and ``delete`` wrote since the last flush fill all in-memory tables (``memtable_count`` of
    ``memtable_size`` bytes) they are flushed, and full levels are merged. Reads of a key, a prefix or a range open only the
    runs that the manifest's bounds and filters allow. Scans are not metered, as opposed to reads, writes and iterators.
    """

    def __init__(self, spark: SparkSession, base: str, config: KVConfig | None = None, clock=time.time):
        self.spark, self.base, self.config = spark, base.rstrip("/"), config or KVConfig()
        self.clock = clock
        self.limiter = Limiter(self.config.max_token, self.config.token_refill_rate, clock)
        self.buffer: list[tuple] = []
        self._seq = 0
        newest = self.log().agg(F.max("seq").alias("m"), F.lit(1)).first().m
        top = self.listed().agg(F.max("max_seq").alias("m")).first().m
        self._seq = max(newest or 0, top or 0)
        self._held = self.log().agg(F.sum(R.row_bytes())).first()[0] or 0

    # Storage.

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def log(self) -> DataFrame:
        path = f"{self.base}/wal"
        if self._exists(path):
            return self.spark.read.schema(MUTATION).parquet(path)
        return self.spark.createDataFrame([], MUTATION)

    def runs(self) -> DataFrame:
        path = f"{self.base}/runs"
        if self._exists(path):
            return R.open_runs(self.spark, path)
        return self.spark.createDataFrame([], "key string, op string, value string, seq long, level int, run_id string")

    def listed(self) -> DataFrame:
        """The runs' manifest."""
        path = f"{self.base}/runs"
        if self._exists(R.manifest_path(path)):
            return R.listed(self.spark, path)
        return self.spark.createDataFrame([], f"{R.MANIFEST}, level int, run_id string")

    def mutations(self, may: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Everything that reads look at: buffer, log and runs; of those with ``may`` only the ones that it leaves of the
        manifest."""
        runs = self.runs()
        if may is not None:
            runs = runs.where(F.col("run_id").isin([r.run_id for r in may(self.listed()).select("run_id").collect()]))
        both = self.log().select("key", "op", "value", "seq").unionByName(runs.select("key", "op", "value", "seq"))
        if self.buffer:
            both = both.unionByName(self.spark.createDataFrame(self.buffer, MUTATION).select("key", "op", "value", "seq"))
        return both

    # Writes.

    def _meter(self, user: str) -> None:
        if not self.limiter.allows(user):
            raise RateLimited(f"{user} is out of tokens")

    def _mutate(self, user: str, op: str, key: str, value: str) -> None:
        if not key:
            raise ValueError("a key is not empty")
        self._meter(user)
        self._seq += 1
        self.buffer.append((self._seq, int(self.clock()), user, op, key, value))
        self._held += len(key.encode()) + len(value.encode())
        if self._held >= self.config.memtable_count * self.config.memtable_size:
            self.flush()
            self.compact()
        elif len(self.buffer) >= self.config.wal_buffer_size:
            self.sync()

    def put(self, user: str, key: str, value: str) -> None:
        self._mutate(user, PUT, key, value)

    def delete(self, user: str, key: str) -> None:
        self._mutate(user, DELETE, key, "")

    def write(self, rows: DataFrame) -> None:
        """Append rows of MUTATION in bulk; their ``seq`` counts from the store's last one."""
        self.sync()
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in MUTATION.fields])
        rows.withColumn("seq", F.col("seq") + self._seq).write.mode("append").parquet(f"{self.base}/wal")
        self._seq = self.log().agg(F.max("seq")).first()[0] or self._seq

    def sync(self) -> None:
        if self.buffer:
            self.spark.createDataFrame(self.buffer, MUTATION).coalesce(1).write.mode("append").parquet(f"{self.base}/wal")
            self.buffer = []

    def flush(self) -> str | None:
        """The log as a run of level 0; the log goes only after the run is written."""
        self.sync()
        if self.log().isEmpty():
            return None
        run = R.flush(self.log(), f"{self.base}/runs", 0, f"{self._seq:020d}", config=self.config)
        self._delete(f"{self.base}/wal")
        self._held = 0
        return run

    def compact(self, policy: str = compaction.NEWEST) -> int:
        if not self._exists(f"{self.base}/runs"):
            return 0
        return compaction.compact(self.spark, f"{self.base}/runs", self.config.compaction_threshold, self.config.lsm_levels, policy, self.config)

    def validate(self) -> DataFrame:
        """``level, run_id, valid``: whether each run's rows still give the Merkle root that was stored with it."""
        return R.invalid(self.listed(), self.runs())

    def close(self) -> None:
        self.sync()

    # Reads.

    def get(self, user: str, key: str) -> str | None:
        self._meter(user)
        row = V.get(self.mutations(lambda m: R.may_hold_key(m, key)), key).first()
        return row.value if row else None

    def _with_prefix(self, prefix: str) -> DataFrame:
        return self.mutations((lambda m: R.may_hold_prefix(m, prefix, self.config)) if prefix else None)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return V.multi_get(self.mutations(), keys)

    def prefix_scan(self, prefix: str, page: int, size: int) -> DataFrame:
        return V.page(V.prefix(self._with_prefix(prefix), prefix), page, size)

    def range_scan(self, low: str, high: str, page: int, size: int) -> DataFrame:
        return V.page(V.key_range(self.mutations(lambda m: R.may_hold(m, low, high)), low, high), page, size)

    def prefix_iterate(self, user: str, prefix: str) -> Cursor:
        self._meter(user)
        return Cursor(V.prefix(self._with_prefix(prefix), prefix))

    def range_iterate(self, user: str, low: str, high: str) -> Cursor:
        self._meter(user)
        return Cursor(V.key_range(self.mutations(lambda m: R.may_hold(m, low, high)), low, high))

    def stats(self) -> DataFrame:
        return R.stats_of(self.listed())

    def view(self, cached: bool = False) -> DataFrame:
        """Live ``key, value`` rows, for any SQL; ``cached`` keeps them in storage memory, which Spark evicts by use."""
        rows = V.view(self.mutations())
        return rows.persist() if cached else rows
