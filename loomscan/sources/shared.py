"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; an own one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="loomscan-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
        _delete_at_end(spark, found)
    return found.rstrip("/")


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    """Make a folder that goes when the driver's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)


def fresh_dir(spark: SparkSession, kind: str = "files") -> str:
    """A name, not used before, for a folder below the shared one; what is written there goes when the driver ends."""
    folder = f"{shared_dir(spark)}/loomscan-{kind}-{uuid.uuid4().hex}"
    _delete_at_end(spark, folder)
    return f"{folder}/data"
