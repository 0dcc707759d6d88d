"""Size-tiered compaction: planning over the manifest and merging of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DELETE, KVConfig
from .runs import listed, manifest_path, open_runs, write_run
from .view import latest

NEWEST, TOMBSTONE_WINS = "newest", "tombstone_wins"


def merge(runs: DataFrame, policy: str = NEWEST, purge: bool = False) -> DataFrame:
    """One row ``key, op, value, seq`` per key.

    ``newest``: the greatest seq holds. ``tombstone_wins``: a deletion in any run holds, else the run whose id comes
    first, ids of whatever kind. ``purge`` drops deletions, which is right only where nothing older lies below.
    """
    if policy == NEWEST:
        out = latest(runs)
    elif policy == TOMBSTONE_WINS:
        newest = F.min_by(F.struct("op", "value", "seq"), F.struct(F.col("op") != DELETE, "run_id", -F.col("seq")))
        out = runs.groupBy("key").agg(newest.alias("v")).select("key", "v.op", "v.value", "v.seq")
    else:
        raise ValueError(f"no merge policy {policy!r}")
    return out.where(F.col("op") != DELETE) if purge else out


def plan(manifest: DataFrame, threshold: int, levels: int) -> DataFrame:
    """Which runs are merged with which: on each level below ``levels`` full batches of ``threshold`` runs in order.
    ``level, run_id, batch, to_level`` from a manifest, which has a row per run."""
    w = Window.partitionBy("level")
    p = manifest.select("level", "run_id", (F.row_number().over(w.orderBy("run_id")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    p = p.where((F.col("level") < levels) & (F.floor(F.col("k") / threshold) < F.floor(F.col("n") / threshold)))
    return p.select("level", "run_id", F.floor(F.col("k") / threshold).cast("long").alias("batch"), (F.col("level") + 1).alias("to_level"))


def compact(spark: SparkSession, base: str, threshold: int, levels: int, policy: str = NEWEST, config: KVConfig = KVConfig()) -> int:
    """Merge until no level has a full batch, the oldest runs of a level first. Returns the number of merges.

    Runs are listed from the manifest. A new run and its entry are written before old ones are deleted, and of those the
    one with the oldest mutations goes first: whenever the work stops, what a deletion hides is gone before the deletion,
    and what is left holds the same live rows. Deletions are dropped where the output is the deepest data.
    """
    merges = 0
    for level in range(levels):
        while True:
            runs = [(r.level, r.run_id) for r in listed(spark, base).select("level", "run_id", "max_seq").orderBy("max_seq", "run_id").collect()]
            batch = [run for at, run in runs if at == level][:threshold]
            if len(batch) < threshold:
                break
            deepest = not any(at > level or (at == level and run not in batch) for at, run in runs)
            rows = open_runs(spark, base).where((F.col("level") == level) & F.col("run_id").isin(batch))
            write_run(merge(rows, policy, purge=deepest), base, level + 1, uuid.uuid4().hex, config=config)
            for run in batch:
                for folder in (base, manifest_path(base)):
                    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/level={level}/run_id={run}")
                    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            merges += 1
    return merges
