"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


_sent: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application, unless their path has it already."""
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if ROOT in paths or sc.applicationId in _sent:
        return
    file = Path(tempfile.mkdtemp(prefix="spark-")) / "tablewright.zip"  # read again by executors that start later
    with zipfile.ZipFile(file, "w") as z:
        for source in sorted((ROOT / "tablewright").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
    sc.addPyFile(str(file))
    sys.path[:] = [p for p in sys.path if not p.endswith("tablewright.zip")]
    _sent.add(sc.applicationId)
