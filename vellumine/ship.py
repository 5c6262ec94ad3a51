"""Sends this package to the executors, once for each Spark application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, bounds Arrow batches unless the session does; returns the session."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="vellumine-")) / "vellumine_code.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        if spark.conf.get(BATCH) == "67108864b":  # a batch of long texts is in memory several times
            spark.conf.set(BATCH, "8m")
        _shipped.add(app)
    return spark
