"""Folders for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_fallback: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the cluster shares (spark.checkpoint.dir).

    Where that is unset, a temporary one stands in for it on a local master, as in tests; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _fallback:
            _fallback[app] = "file://" + tempfile.mkdtemp(prefix="spark-loom-")
        at = _fallback[app]
    return f"{at.rstrip('/')}/loom/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """A path of Hadoop's and the file system that it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it is not there."""
    at, system = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder and all below it."""
    at, system = _at(spark, path)
    system.delete(at, True)
