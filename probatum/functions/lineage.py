"""Cutting lineage, and new folders, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _checkpoints(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Only a local session without such a folder gets a temporary one; on a cluster that would be one machine's own, so it is an error.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if not given.isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="probatum-")
        sc.setCheckpointDir(path)
        given = sc._jsc.sc().getCheckpointDir()
    return given.get().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, deleted when the driver ends."""
    path = f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the checkpoint folder, so that what uses it often computes it once and outlives lost executors."""
    _checkpoints(df.sparkSession)
    return df.checkpoint()
