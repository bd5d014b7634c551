"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 16 << 20


def shared_root(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where it is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            root = sc._jsc.sc().getCheckpointDir().get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            root = "file://" + tempfile.mkdtemp(prefix="spark-")
            sc.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, row_bytes: Column) -> DataFrame:
    """The frame, marked for broadcast if the bytes of all its rows are few; else joins shuffle it."""
    total = frame.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(frame) if total <= BROADCAST_BYTES else frame
