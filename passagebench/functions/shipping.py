"""Makes this package importable in the Python workers, wherever the driver was started, and bounds what they get at once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_done: set[str] = set()


#: Of texts in an Arrow batch, whatever its rows: what a worker makes of a batch is several times as large.
BATCH_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _done or str(ROOT) in known or os.getcwd() == str(ROOT):
        return
    archive = Path(tempfile.mkdtemp(prefix="passagebench-")) / "passagebench.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (ROOT / "passagebench").rglob("*.py"):
            if "llm" not in p.relative_to(ROOT).parts:
                z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _done.add(app)
