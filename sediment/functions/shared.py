"""The folder that the driver and all executors share, and tables in it that end a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SHARED_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}  # by application


def shared_dir(spark: SparkSession) -> str:
    """Read from the session. Only where the session names none and runs in one process, as in a local test, one is set;
    on a cluster a folder of one machine would lose rows, so there the setting is required."""
    found = spark.conf.get(SHARED_KEY, None) or spark.sparkContext.getConf().get(SHARED_KEY)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SHARED_KEY} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="sediment-")
    return found.rstrip("/")


#: Frames that ``written`` made, with their folders, until they are discarded.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: lineage ends here and a lost
    executor costs nothing of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(back)] = (back, path)
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing that is yet to run reads them."""
    for df in frames:
        _, path = _PATHS.pop(id(df), (None, None))
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def settled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The frame that ``make`` gives, as a table; all other tables that were written for it are deleted."""
    before = set(_PATHS)
    out = written(make(), label)
    discard(*[df for key, (df, _) in list(_PATHS.items()) if key not in before and df is not out])
    return out


_FOLDERS: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, deleted when the program ends."""
    _FOLDERS.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


@atexit.register
def _discard_the_rest() -> None:
    """Tables that a result still read go with the program, if its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        discard(*[df for df, _ in list(_PATHS.values())])
        for path in _FOLDERS:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
