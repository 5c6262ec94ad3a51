"""Tables written to the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only
when it is unset, and only on a ``local`` master, a temporary folder is made.
A lazy result may need its tables as long as the application runs; they are
deleted when the driver ends, or before by ``delete``.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_made: dict[SparkSession, list[str]] = {}
_collecting: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("collecting", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    conf = spark.sparkContext.getConf()
    named = conf.get(KEY, None) or spark.conf.get(KEY, None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"set {KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        folder = tempfile.mkdtemp(prefix="vellumine-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local[app] = "file://" + folder
    return _local[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns; what is there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark not in _made:
        _made[spark] = []
        atexit.register(_end, spark)
    _made[spark].append(path)
    if (inner := _collecting.get()) is not None:
        inner.append(path)
    return path


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The paths that are made within, in order."""
    token = _collecting.set([])
    try:
        yield _collecting.get()
    finally:
        _collecting.reset(token)


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes what is at some paths of the shared folder."""
    sc = spark.sparkContext
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    _made[spark] = [p for p in _made.get(spark, []) if p not in set(paths)]


def _end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        delete(spark, list(_made[spark]))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
