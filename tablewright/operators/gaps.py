"""Missing change ids: late changes are kept as gaps until they are seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.operators.capture import CHANGE_ID

CELL = 1_000_000


def gap_ranges(log: DataFrame, start: int = 0) -> DataFrame:
    """first, last of each run of ids over `start` that are missing below the largest id. Ids are looked at in
    cells, so no task orders the whole log; neighbours of a cell's edge come from the cells' extremes."""
    ids = log.select(F.col(CHANGE_ID).alias("id")).where(F.col("id") > start).withColumn("cell", F.floor(F.col("id") / CELL))
    within = ids.select("id", F.lag("id").over(Window.partitionBy("cell").orderBy("id")).alias("before")).where("before IS NOT NULL")
    edges = ids.groupBy("cell").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    across = edges.select(F.col("low").alias("id"), F.coalesce(F.lag("high").over(Window.orderBy("cell")), F.lit(start)).alias("before"))
    return within.unionByName(across).where("id > before + 1").select((F.col("before") + 1).cast("long").alias("first"), (F.col("id") - 1).cast("long").alias("last"))


def gap_ids(log: DataFrame, start: int = 0) -> DataFrame:
    """missing_id: every one, a long gap cut into pieces of CELL ids first."""
    pieces = gap_ranges(log, start).select("first", "last", F.explode(F.sequence("first", "last", F.lit(CELL).cast("long"))).alias("low"))
    return pieces.select(F.explode(F.sequence("low", F.least("last", F.col("low") + (CELL - 1)))).alias("missing_id"))


def _in_cells(ranges: DataFrame) -> DataFrame:
    """The ranges, once for each cell of ids that they touch, so that ids meet them by cell."""
    return ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))))


def in_ranges(ids: DataFrame, ranges: DataFrame) -> DataFrame:
    """The ids (change_id) that lie in a range (first, last; ranges do not overlap)."""
    placed = ids.withColumn("__cell", F.floor(F.col(CHANGE_ID) / CELL))
    inside = (F.col("__cell") == F.col("cell")) & F.col(CHANGE_ID).between(F.col("first"), F.col("last"))
    return placed.join(_in_cells(ranges), inside, "left_semi").drop("__cell")


def still_missing(ranges: DataFrame, found: DataFrame) -> DataFrame:
    """first, last of what is left of missing ranges without the ids found (id). Ranges are cut at cells first, so that one row
    holds at most a cell's ids; pieces that meet at a cell's edge stay two ranges."""
    edge = F.col("cell") * CELL
    parts = _in_cells(ranges).select("cell", F.greatest("first", edge).alias("first"), F.least("last", edge + (CELL - 1)).alias("last"))
    near = found.distinct().withColumn("cell", F.floor(F.col("id") / CELL)).alias("f").join(parts.alias("p"), (F.col("f.cell") == F.col("p.cell")) & F.col("id").between(F.col("first"), F.col("last")))
    by = Window.partitionBy("first", "last").orderBy("id")
    before = near.select("first", "last", "id", F.lag("id").over(by).alias("before"))
    inner = before.select(F.coalesce(F.col("before") + 1, F.col("first")).alias("a"), (F.col("id") - 1).alias("b"))
    tail = near.groupBy("first", "last").agg((F.max("id") + 1).alias("a")).select("a", F.col("last").alias("b"))
    whole = parts.join(near.select("first", "last").distinct(), ["first", "last"], "left_anti").select(F.col("first").alias("a"), F.col("last").alias("b"))
    left = inner.unionByName(tail).unionByName(whole).where("a <= b")
    return left.select(F.col("a").cast("long").alias("first"), F.col("b").cast("long").alias("last"))
