"""Intermediate tables in the shared folder, and what plans need to know about sizes."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is sent to every task only when it is known to be at most so large; beyond that it is joined by key.
BROADCAST_BYTES = 32 << 20
_local: dict[str, str] = {}
_folders: list[tuple] = []


def work_folder(spark: SparkSession) -> str:
    """A new folder inside the shared one that the cluster names in spark.checkpoint.dir.

    Only in local mode, as in tests, may that setting be absent: a temporary folder stands in for it. What is in the folder
    is needed while results that are made from it are read; `release`, or the end of the driver, deletes it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="passagebench-")
            spark.sparkContext.setCheckpointDir(_local[app])
        base = _local[app]
    folder = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
    _folders.append((folder, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()))
    return folder


def release() -> None:
    """Delete the intermediate tables made so far; results not yet read can't be read afterwards."""
    while _folders:
        folder, jvm, conf = _folders.pop()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_end() -> None:
    try:
        release()
    except Exception:  # the JVM may have ended before
        _folders.clear()


def stored(df: DataFrame, folder: str | None = None, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive lost executors without its lineage."""
    path = f"{folder or work_folder(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(columns: Iterable[str], name: str) -> str:
    """The name, or the name with as many underscores as it takes to be no column's, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def size_of(df: DataFrame) -> int:
    """Bytes, by the estimate that the plan has from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def to_all(df: DataFrame) -> DataFrame:
    """A stored table, sent to every task where it is small: its files are several times smaller than its rows in memory."""
    return F.broadcast(df) if size_of(df) <= BROADCAST_BYTES // 8 else df


def spread(rows: DataFrame, least: int = 16 << 20) -> DataFrame:
    """The rows dealt out to all cores, where the table is too small for its files to do that.

    A file of one row group is read by one task, however it is split. Tables of more than `least` bytes a core, by the
    estimate that the scan has from its files, are left as they are: they have row groups enough, and aren't shuffled.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if cores > 1 and size_of(rows) < least * cores else rows


def dealt(rows: DataFrame) -> DataFrame:
    """The same for tables that several jobs read: what has to be dealt out is written, once."""
    out = spread(rows)
    return rows if out is rows else stored(out)
