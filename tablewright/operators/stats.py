"""Figures of a run, observed inside the jobs that compute its stages: no job is run for a count alone."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import quoted

#: Bytes of values of fixed width; others count as the bytes of their text.
WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def row_bytes(frame: DataFrame) -> F.Column:
    """Bytes of a row's values, nulls none."""
    fixed = lambda f: F.when(F.col(quoted(f.name)).isNotNull(), WIDTH[type(f.dataType)]).otherwise(0).cast("long")
    text = lambda f: F.coalesce(F.octet_length(F.col(quoted(f.name)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(F.col(quoted(f.name))))), F.lit(0)).cast("long")
    return functools.reduce(operator.add, [fixed(f) if type(f.dataType) in WIDTH else text(f) for f in frame.schema], F.lit(0).cast("long"))


class RunStats:
    """Rows, bytes and seconds of each stage, in order."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}
        self.seconds: dict[str, float] = {}

    def watched(self, stage: str, frame: DataFrame) -> DataFrame:
        """The frame, whose rows and bytes are counted by the job that computes it."""
        self.seen[stage] = Observation(f"{stage}")
        return frame.observe(self.seen[stage], F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(frame)), F.lit(0)).cast("long").alias("bytes"))

    def took(self, stage: str, seconds: float) -> None:
        self.seconds[stage] = seconds

    def rows(self) -> list[tuple[str, int | None, int | None, float, float | None]]:
        """stage, rows, bytes, seconds, rows a second; stages that compute no frame have seconds only."""
        out = []
        for stage, seconds in self.seconds.items():
            found = self.seen[stage].get if stage in self.seen else {}
            n = found.get("rows")
            out.append((stage, n, found.get("bytes"), seconds, None if n is None else n / max(seconds, 1e-9)))
        return out
