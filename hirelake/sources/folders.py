"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str = "landing") -> str:
    """A new folder's name under the one the session names in spark.checkpoint.dir; only a session on one machine gets its
    own. What is written there goes when the driver's JVM ends, since results that read it are lazy."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-stream-")
    folder = f"{root}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)  # a path that isn't there yet can't be marked
    files.deleteOnExit(path)
    return folder
