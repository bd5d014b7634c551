"""Change capture: two snapshots, or images before and after, become an ordered change log."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import columns, quoted

INSERT, DELETE, UPDATE = 1, 2, 3
CHANGE_ID, DML_TYPE = "change_id", "dml_type"


def empty_log(table: DataFrame) -> DataFrame:
    """The log's columns for a table, without rows."""
    return table.limit(0).select(F.lit(0).cast("long").alias(CHANGE_ID), F.lit(0).cast("long").alias(DML_TYPE), "*")


def snapshot_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """dml_type and row of what turns old into new: keys of one side only are inserted or deleted, others updated if any column differs."""
    rest = [c for c in old.columns if c not in keys]
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    both = o.join(n, keys, "full_outer")
    differs = functools.reduce(operator.or_, [~F.col(f"o.{quoted(c)}").eqNullSafe(F.col(f"n.{quoted(c)}")) for c in rest], F.lit(False))
    kind = F.when(F.col("__old").isNull(), INSERT).when(F.col("__new").isNull(), DELETE).when(differs, UPDATE)
    image = [F.when(F.col("__new").isNull(), F.col(f"o.{quoted(c)}")).otherwise(F.col(f"n.{quoted(c)}")).alias(c) for c in rest]
    return both.withColumn(DML_TYPE, kind.cast("long")).where(F.col(DML_TYPE).isNotNull()).select(DML_TYPE, *columns(keys), *image)


def image_changes(images: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """Update images (change_id, before struct, after struct) as changes: a kept key is one update, a moved
    or null key a delete of the old row and then an insert of the new one, told apart by part."""
    kept = functools.reduce(operator.and_, [F.col(f"{before}.{quoted(k)}") == F.col(f"{after}.{quoted(k)}") for k in keys])
    step = lambda part, kind, row: F.struct(F.lit(part).alias("part"), F.lit(kind).cast("long").alias(DML_TYPE), F.col(row).alias("row"))
    moved = F.array(step(0, DELETE, before), step(1, INSERT, after))
    steps = F.when(kept, F.array(step(0, UPDATE, after))).otherwise(moved)
    return images.select(CHANGE_ID, F.explode(steps).alias("s")).select(CHANGE_ID, "s.part", f"s.{DML_TYPE}", "s.row.*")


def in_range(log: DataFrame, low: int, high: int | None) -> DataFrame:
    above = log.where(F.col(CHANGE_ID) > low)
    return above if high is None else above.where(F.col(CHANGE_ID) <= high)


def by_ids(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The changes of given ids (a frame with a column change_id), as when gaps are looked up again."""
    return log.join(ids.select(CHANGE_ID).distinct(), CHANGE_ID, "left_semi")


def describe(table: DataFrame) -> DataFrame:
    """place, name, type of a table's columns."""
    return table.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(table.schema, 1)], "place int, name string, type string")


def named_with(frame: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose name starts with one of the prefixes: what migrations left behind."""
    return frame.where(functools.reduce(operator.or_, [F.col(quoted(column)).startswith(p) for p in prefixes]))


def last_id(log: DataFrame, ceiling: int | None = None) -> DataFrame:
    top = F.coalesce(F.max(CHANGE_ID), F.lit(0).cast("long"))
    return log.agg((F.least(top, F.lit(ceiling).cast("long")) if ceiling is not None else top).alias("max_id"))


def of_type(kind: int) -> Column:
    return F.col(DML_TYPE) == kind
