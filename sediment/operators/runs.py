"""Sorted runs: writing with their manifest, sparse summary, statistics, and the seek in a summary."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bloom
from ..functions.fold import ordered_fold
from ..schema import DELETE, RUN, KVConfig
from . import integrity
from .order import numbered
from .view import latest

#: Filters of more bits are not stored with a run; Parquet's own, one per row group, stand for them.
STORED_BITS = 1 << 23
#: Hashes of a stored filter at most; one key in 2^20 is mistaken then.
MOST_HASHES = 20
#: Summary entries of one stretch that a seek looks through.
STRETCH = 1024
#: Tasks that the probes of one run are dealt over.
SPLIT = 16

MANIFEST = (
    "min_key string, max_key string, n long, n_deletes long, bytes long, min_seq long, max_seq long, root string, "
    "bloom_bits int, bloom_hashes int, bloom array<long>, prefix_bits int, prefix_hashes int, prefix_bloom array<long>"
)
_STORED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RUN.fields if f.name in ("key", "op", "value", "seq"))


def row_bytes() -> Column:
    return (F.octet_length("key") + F.octet_length(F.coalesce("value", F.lit("")))).cast("long")


def manifest_path(base: str) -> str:
    return f"{base.rstrip('/')}-manifest"


def flush(log: DataFrame, base: str, level: int = 0, run_id: str | None = None, files: int | None = None, config: KVConfig = KVConfig()) -> str:
    """Write the newest version of each key as one run. Returns the run's id."""
    return write_run(latest(log), base, level, run_id or uuid.uuid4().hex, files, config)


def write_run(rows: DataFrame, base: str, level: int, run_id: str, files: int | None = None, config: KVConfig = KVConfig()) -> str:
    """Write rows, one per key, as a run: range-partitioned and sorted by key, so that row groups have narrow bounds, with
    a Bloom filter on the key; and then its row of the manifest. A run counts once that row is there."""
    spark, path = rows.sparkSession, f"{base}/level={level}/run_id={run_id}"
    rows = rows.repartitionByRange(files, "key") if files else rows.repartitionByRange("key")
    rows.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").mode("overwrite").parquet(path)
    own = spark.read.schema(_STORED).parquet(path).select("*", F.lit(level).alias("level"), F.lit(run_id).alias("run_id"))
    entries(own, config).drop("level", "run_id").coalesce(1).write.mode("overwrite").parquet(f"{manifest_path(base)}/level={level}/run_id={run_id}")
    return run_id


def write_runs(runs: DataFrame, base: str, config: KVConfig = KVConfig()) -> None:
    """Write many runs (``level, run_id`` beside the mutations) and their manifest in one go."""
    newest = runs.groupBy("level", "run_id", "key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("v"))
    rows = newest.select("level", "run_id", "key", "v.op", "v.value", "v.seq").repartitionByRange("level", "run_id", "key")
    rows = rows.sortWithinPartitions("level", "run_id", "key")
    rows.write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("level", "run_id").mode("overwrite").parquet(base)
    entries(open_runs(runs.sparkSession, base), config).coalesce(1).write.partitionBy("level", "run_id").mode("overwrite").parquet(manifest_path(base))


def entries(runs: DataFrame, config: KVConfig = KVConfig()) -> DataFrame:
    """The manifest's rows of runs: bounds, counts, Merkle root, Bloom filters of their keys and of their prefixes, all as
    aggregates by run."""
    by = ["level", "run_id"]
    out = manifest(runs).join(integrity.root(integrity.leaves(runs.select(*by, "key", "value"), *by), *by).select(*by, "root"), by)
    each = runs.select(*by, "key")
    rate = config.bloom_filter_false_positive_rate
    cut = bloom.prefixes(each, config.min_prefix_length, config.max_prefix_length, *by)
    for name, keys in (("bloom", each), ("prefix", cut)):
        words = f"{name}_bloom" if name == "prefix" else name
        out = out.join(bloom.packed(keys, rate, STORED_BITS, *by).toDF(*by, f"{name}_bits", f"{name}_hashes", words), by, "left")
    return out.select(*by, *[c.split()[0] for c in MANIFEST.split(", ")])


def listed(spark: SparkSession, base: str) -> DataFrame:
    """The manifest of a store, as it was written: a row per run, whatever its size."""
    return spark.read.schema(f"{MANIFEST}, level int, run_id string").parquet(manifest_path(base))


def open_runs(spark: SparkSession, base: str) -> DataFrame:
    """All runs; ``level`` and ``run_id`` are partitions, so filters on them prune files."""
    return spark.read.schema(f"{_STORED}, level int, run_id string").parquet(base)


def manifest(runs: DataFrame) -> DataFrame:
    """A row per run, computed from its rows: bounds, counts, bytes, sequence span."""
    return runs.groupBy("level", "run_id").agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.count("*").alias("n"),
        F.sum((F.col("op") == DELETE).cast("long")).alias("n_deletes"),
        F.sum(row_bytes()).alias("bytes"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
    )


def may_hold(manifest: DataFrame, low: str, high: str) -> DataFrame:
    """Runs whose bounds meet a range of keys."""
    return manifest.where((F.col("min_key") <= high) & (F.col("max_key") >= low))


def _answers(words: str, bits: str, hashes: str, key: str) -> Column:
    """Whether a stored filter may hold a key; True where none is stored. Sizes differ from run to run."""
    asked = F.lit(True)
    for i in range(MOST_HASHES):
        asked = asked & ((F.col(hashes) <= i) | bloom.is_set(F.col(words), bloom.cell(F.lit(key), i, F.col(bits).cast("long"))))
    return F.coalesce(asked, F.lit(True))


def may_hold_key(listed: DataFrame, key: str) -> DataFrame:
    """Runs whose bounds and whose Bloom filter may hold a key."""
    return may_hold(listed, key, key).where(_answers("bloom", "bloom_bits", "bloom_hashes", key))


def may_hold_prefix(listed: DataFrame, prefix: str, config: KVConfig = KVConfig()) -> DataFrame:
    """Runs whose bounds and whose prefix filter may hold keys with a prefix. Longer prefixes than the filter knows are cut,
    shorter ones are left to the bounds."""
    at = listed.where((F.col("max_key") >= prefix) & ((F.col("min_key") <= prefix) | F.col("min_key").startswith(prefix)))
    if len(prefix) < config.min_prefix_length:
        return at
    return at.where(_answers("prefix_bloom", "prefix_bits", "prefix_hashes", prefix[: config.max_prefix_length]))


def invalid(listed: DataFrame, runs: DataFrame) -> DataFrame:
    """``level, run_id, valid`` for each run: whether its rows still give its stored root."""
    stored = listed.select("level", "run_id", "root")
    return integrity.validate(stored, runs.select("level", "run_id", "key", "value"), "level", "run_id")


def stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("level").agg(
        F.countDistinct("run_id").alias("n_runs"), F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum(row_bytes()).alias("bytes")
    )


def stats_of(listed: DataFrame) -> DataFrame:
    """The same from the manifest alone."""
    return listed.groupBy("level").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("bytes").alias("bytes"))


def sparse_summary(keys: DataFrame, step: int) -> DataFrame:
    """Of each run's distinct keys the first, the last and every ``step``-th: ``run_id, key, rn``."""
    keys = numbered(keys.select("run_id", "key").distinct(), "run_id")
    last = keys.groupBy("run_id").agg(F.max("rn").alias("__last"))
    kept = keys.join(last, "run_id").where((F.col("rn") % step == 0) | (F.col("rn") == F.col("__last")))
    return kept.select("run_id", "key", F.col("rn").cast("int").alias("rn"))


def summary_seek(summary: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe and each run whose bounds hold it the last summary key at or before it: ``run_id, probe, summary_key``.

    Every ``STRETCH``-th summary key begins a stretch. A probe first finds its stretch among those, then its key inside it;
    both are as-of joins by a sort, the first over a run's stretches in ``SPLIT`` tasks, the second over one stretch. Probes
    meet no run that its bounds rule out.
    """
    bounds = summary.groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    asked = bloom.within_bounds(bounds, "run_id", probes.select("key").where("key IS NOT NULL").distinct())
    placed = numbered(summary.select("run_id", "key").distinct(), "run_id", into="at")
    placed = placed.select("run_id", "key", F.floor(F.col("at") / STRETCH).cast("long").alias("stretch"))
    starts = placed.groupBy("run_id", "stretch").agg(F.min("key").alias("key")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(SPLIT)).cast("int"))
    found = _as_of(starts, dealt, ["run_id", "part"], "stretch")
    return _as_of(placed.withColumn("summary_key", F.col("key")), found.select("run_id", "key", "stretch"), ["run_id", "stretch"], "summary_key").select(
        "run_id", F.col("key").alias("probe"), "summary_key"
    )


def _as_of(entries: DataFrame, probes: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by..., key, value``: of each probe the value of the last entry at or before it in its group."""
    both = entries.select(*by, "key", F.lit(0).alias("__side"), F.col(value).alias("__value"))
    kind = entries.schema[value].dataType
    both = both.unionByName(probes.select(*by, "key", F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__value")))
    w = Window.partitionBy(*by).orderBy("key", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("__found", F.last("__value", ignorenulls=True).over(w)).where("__side = 1").select(*by, "key", F.col("__found").alias(value))


def flush_points(log: DataFrame, limit: int, by: str = "user") -> DataFrame:
    """Which in-memory table of its user (or of another group ``by``; a constant one for a table that all share) each
    mutation falls in: a table takes rows, overwritten ones included, until their bytes reach ``limit``, and the next row
    opens a new one. Where a table begins depends on all before, so a group is one task's."""

    def step(state: tuple[int, int], size: int) -> tuple:
        held, table = state
        if held >= limit:
            held, table = 0, table + 1
        return (held + size, table), (table,)

    return ordered_fold(log.select(by, "seq", row_bytes().alias("bytes")), by, "seq", ["bytes"], lambda: (0, 0), step, "memtable long")
