"""The folder for tables between steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context was given; in local mode, where there is one machine, else a temporary one that goes at exit."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _own[0].removeprefix("file://"), ignore_errors=True)
    return _own[0]


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files give fewer tasks than there are: a small file of one row group would keep one core busy. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there goes with discard(), or when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_forget)
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, its steps aren't run again, and it outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scoped(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables and paths that are made within go at its end, for a caller that has read what it needs of them. It gives a function that keeps the table that it is called with."""
    before, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(x[1] for x in _made for f in df.inputFiles() if x[1].rsplit("/", 1)[-1] in f)
        return df

    try:
        yield keep
    finally:
        for at in [x for x in _made[before:] if x[1] not in kept]:
            _delete(*at)
            _made.remove(at)


def sweep(spark: SparkSession, hours: float = 72.0) -> int:
    """Delete what drivers that were killed have left in the shared folder: scratch paths that nothing was written to for so long. How many there were. A path's age is that of the newest of its entries."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    own, now, gone = {x[1].rsplit("/", 1)[-1] for x in _made}, time.time() * 1000, 0
    for found in system.listStatus(root) if system.exists(root) else []:
        name = found.getPath().getName()
        if name.startswith("quire-") and name not in own and found.isDirectory():
            newest = max([found.getModificationTime(), *[f.getModificationTime() for f in system.listStatus(found.getPath())]])
            if now - newest > hours * 3_600_000:
                gone += bool(system.delete(found.getPath(), True))
    return gone


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of written() that are no longer read."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            for at in [x for x in _made if x[1].rsplit("/", 1)[-1] in file]:
                _delete(*at)
                _made.remove(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _forget() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  if the session has ended, the folder is the cluster's to clean
            continue
