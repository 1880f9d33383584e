"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the one of setCheckpointDir.

    Where neither is set, a local master gets a folder of its own; on a cluster
    that would be a different disk for each executor, so it is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", "") or getattr(context, "_graphloom_dir", "")
    if not found:
        given = context._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else ""
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = context._graphloom_dir = f"file:///tmp/checkpoints/{uuid.uuid4().hex}"
    return found.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    """Delete what the sessions of this process have staged."""
    for spark, path in _written:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session has ended already
            return


def written(df: DataFrame) -> str:
    """The path of df in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clear)
    _written.append((df.sparkSession, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: one copy that outlives any executor, with its true size for the planner."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))
