"""What the operators of this subpackage share: where tables go, how code reaches the workers, batch sizes."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES, free, release, stored, work_folder

__all__ = ["BROADCAST_BYTES", "free", "release", "stored", "work_folder"]

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def text_bytes_of(docs: DataFrame) -> int:
    """Bytes of all texts: one pass over one column."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def groups(spark: SparkSession, size: int, most: int = 24 << 20) -> int:
    """Into how many hash ranges that many bytes are spread, so that none holds much more than `most`."""
    return max(shards(spark), -(-size // most))


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches and make this package importable in the workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    app = spark.sparkContext.applicationId
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(ROOT) in paths or os.getcwd() == str(ROOT):
        return
    archive = Path(tempfile.mkdtemp(prefix="passagebench-code-")) / "passagebench_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (ROOT / "passagebench").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shards(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def grouped(f, **fixed):
    """A function for applyInArrow over one group, with its other arguments fixed."""

    def call(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return f(key, table, **fixed)

    return call


def cogrouped(f, **fixed):
    """A function for applyInArrow over a pair of groups, with its other arguments fixed."""

    def call(key, left, right):
        return f(key, left, right, **fixed)

    return call


def lean(f):
    """A mapper that gives memory back to the system when its task ends: workers live on, and idle memory counts."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        try:
            yield from f(*args, **kwargs)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return run
