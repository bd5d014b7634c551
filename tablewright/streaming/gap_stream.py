"""Missing change ids as streaming state: each cell of ids keeps its own missing ranges, and for how many rounds they have been missing.

A cell is closed by the first id of the cell behind it: what it lacks then is missing up to its end. Late ids shrink its ranges; in
rounds that bring a cell nothing its timer fires, and its ranges grow older. Where whole cells have no ids there is no state: what lies between a cell's
last id and the next known cell is missing too. A restart goes on from the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tablewright.operators.capture import CHANGE_ID
from tablewright.operators.gaps import CELL

#: high: ids up to here are seen or missing. repeated: ids that were seen before.
STATE = "high long, firsts array<long>, lasts array<long>, ages array<long>"
TOLD = "cell long, high long, first long, last long, age long, repeated long"


def without(firsts: np.ndarray, lasts: np.ndarray, ages: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rising ranges without some (rising, distinct) ids, and how many of these lie in none of them."""
    if not len(firsts):
        return firsts, lasts, ages, len(ids)
    at = np.searchsorted(firsts, ids, "right") - 1
    inside = (at >= 0) & (ids <= lasts[np.maximum(at, 0)])
    cut, of = ids[inside], at[inside]
    a = np.concatenate([firsts, cut + 1])
    owner = np.concatenate([np.arange(len(firsts)), of])
    order = np.argsort(a, kind="stable")
    a, owner = a[order], owner[order]
    b = lasts[owner]
    same = np.append(owner[1:] == owner[:-1], False)
    b[same] = a[1:][same[:-1]] - 2  # up to the id that is cut out
    some = a <= b
    return a[some], b[some], ages[owner][some], int((~inside).sum())


def cell_rows(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState, start: int, size: int) -> Iterator[pd.DataFrame]:
    """One round of a cell: its missing ranges (one row without a range where there are none)."""
    cell = int(key[0])
    low, top = max(cell * size, start + 1), (cell + 1) * size - 1
    high, firsts, lasts, ages = state.get if state.exists else (low - 1, [], [], [])
    firsts, lasts, ages = (np.array(x, np.int64) for x in (firsts, lasts, ages))
    repeated = 0
    if state.hasTimedOut:
        ages = ages + 1
    else:
        ids = pd.concat([p["id"] for p in pieces])
        closes, known = bool(ids.isna().any()), ids.dropna().astype("int64")
        repeated = len(known) - known.nunique()
        ids = np.unique(known.to_numpy())
        firsts, lasts, ages, seen = without(firsts, lasts, ages + 1, ids[ids <= high])
        repeated += seen
        fresh = np.concatenate([[high], ids[ids > high], [top + 1] if closes and high < top else []]).astype(np.int64)
        gap = np.flatnonzero(np.diff(fresh) > 1)
        firsts, lasts, ages = np.concatenate([firsts, fresh[gap] + 1]), np.concatenate([lasts, fresh[gap + 1] - 1]), np.concatenate([ages, np.zeros(len(gap), np.int64)])
        high = int(max(high, min(fresh[-1], top)))
    state.update((high, firsts.tolist(), lasts.tolist(), ages.tolist()))
    if len(firsts):
        state.setTimeoutDuration(1)
    none = pd.array([None], "Int64")
    yield pd.DataFrame({"cell": cell, "high": high, "first": firsts, "last": lasts, "age": ages, "repeated": repeated} if len(firsts) else {"cell": pd.array([cell], "int64"), "high": high, "first": none, "last": none, "age": none, "repeated": repeated})


def tracked(ids: DataFrame, start: int = 0, size: int = CELL) -> DataFrame:
    """A stream of TOLD rows, every round those of the cells that changed or grew older, from a stream of changes; ids up to `start` are known."""
    cell = F.floor(F.col(CHANGE_ID) / size).cast("long")
    here = F.struct(cell.alias("cell"), F.col(CHANGE_ID).cast("long").alias("id"))
    closed = F.struct((cell - 1).alias("cell"), F.lit(None).cast("long").alias("id"))
    rows = ids.where(F.col(CHANGE_ID) > start).select(F.explode(F.array(here, closed)).alias("r")).select("r.*").where(F.col("cell") >= start // size)
    return rows.groupBy("cell").applyInPandasWithState(lambda key, pieces, state: cell_rows(key, pieces, state, start, size), TOLD, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


class GapTracker:
    """What a stream's rounds told, one folder each, and what is missing now."""

    def __init__(self, spark: SparkSession, path: str, start: int = 0, size: int = CELL):
        self.spark, self.path, self.start, self.size = spark, path, start, size

    def round(self, changes: DataFrame, checkpoint: str) -> None:
        """Everything that is there, then stop. Timers fire in rounds that have data: batches for timers alone would never end."""
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{self.path}/round={number}")
        alone = "spark.sql.streaming.noDataMicroBatches.enabled"
        before = self.spark.conf.get(alone)
        self.spark.conf.set(alone, "false")
        try:
            query = tracked(changes, self.start, self.size).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        finally:
            self.spark.conf.set(alone, before)
        query.awaitTermination()

    def told(self) -> DataFrame:
        """The last word on each cell."""
        rows = self.spark.read.schema(f"{TOLD}, round long").parquet(self.path)
        last = rows.groupBy("cell").agg(F.max("round").alias("round"))
        return rows.join(last, ["cell", "round"], "left_semi")

    def missing(self) -> DataFrame:
        """first, last, age of the missing ranges; age: rounds since one was found, null for cells without state."""
        told = self.told()
        ends = told.groupBy("cell").agg(F.max("high").alias("high"))  # one row for each cell of `size` ids
        by = Window.orderBy("cell")
        upto = F.coalesce(F.lag("high").over(by), F.lit(self.start))
        between = ends.select((upto + 1).alias("first"), (F.greatest(F.col("cell") * self.size, F.lit(self.start + 1)) - 1).alias("last"), F.lit(None).cast("long").alias("age")).where("first <= last")
        return told.where("first IS NOT NULL").select("first", "last", "age").unionByName(between)

    def too_old(self, rounds: int) -> DataFrame:
        """Missing ranges that so many rounds did not fill."""
        return self.missing().where(F.col("age") >= rounds)
