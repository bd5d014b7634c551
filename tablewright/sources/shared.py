"""Results computed once, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; in local mode a temporary folder where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
            folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder or sc._jsc.sc().getCheckpointDir().get()


def computed(frame: DataFrame) -> DataFrame:
    """The frame, computed now: its lineage is cut and a lost executor costs none of the work before."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()
