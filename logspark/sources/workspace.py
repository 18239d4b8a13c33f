"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; on one machine, where none is set, a temporary one.

    On a cluster without spark.checkpoint.dir there is no folder that all executors see: ValueError.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def workspace(spark: SparkSession) -> str:
    """A name below the shared folder that nothing has yet; what is written there is removed when the session's JVM ends."""
    path = f"{shared_root(spark)}/logspark-{uuid.uuid4().hex}"
    place, files = _hadoop(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/data"


def remove(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _hadoop(spark, path)
    return files.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below path, in order; none if there is no such folder."""
    place, files = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(place)) if files.exists(place) else []


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())
