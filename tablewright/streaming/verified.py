"""Verification of changes round by round: each round looks at the changes since the last one, never at the whole log.

A store beside the target keeps, version by version, up to which change id all keys were found equal, which ids below it were missing
then, and the keys that the round looked at. A round reads the changes behind that id, and those missing ones that have come since."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import MigrationError
from tablewright.functions.columns import columns, matches, md5_prefix
from tablewright.operators.capture import CHANGE_ID, by_ids, in_range
from tablewright.operators.gaps import gap_ranges, in_ranges, still_missing
from tablewright.operators.verify import compared, require_equal, sums
from tablewright.sources.shared import computed
from tablewright.streaming.commits import Commit, CommitLog


class VerifiedChanges:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], names: list[str], window: int = 500):
        """keys: of the table; names: the columns to compare; window: ids of one checksum."""
        self.spark, self.path, self.keys, self.names, self.window = spark, path, keys, names, window
        self.commits = CommitLog(spark, f"{path}/commits")

    def start(self, verified: int = 0) -> None:
        """All changes up to this id are known to be equal, as after a comparison of whole tables."""
        if not self.commits.claim(Commit(0, "start", 0, None, verified, "")):
            raise MigrationError("TABLE_ALREADY_EXIST", table=self.path)

    def verified(self) -> int:
        return self.commits.entries()[-1].last_id

    def missing(self) -> DataFrame:
        """first, last of the ranges of ids below the verified one that had not come."""
        folder = self.commits.entries()[-1].folder
        return self.spark.read.parquet(f"{folder}/missing") if folder else self.spark.createDataFrame([], "first long, last long")

    def fresh(self, log: DataFrame, high: int | None = None) -> DataFrame:
        """The changes of the next round: behind the verified id (up to `high`), and missing ones that have come."""
        low, open_ = self.verified(), self.missing()
        new = in_range(log, low, high)
        edge = open_.agg(F.min("first"), F.max("last")).first()
        if edge[0] is None:
            return new
        back = log.where(F.col(CHANGE_ID).between(*edge))  # a scan can leave the rest out
        return new.unionByName(by_ids(back, in_ranges(back.select(CHANGE_ID), open_)))

    def touched(self) -> DataFrame:
        """The keys that all rounds looked at, with the ids of their changes that made them do so."""
        folders = [f"{c.folder}/keys" for c in self.commits.entries() if c.folder]
        return self.spark.read.parquet(*folders)

    def round(self, log: DataFrame, table: DataFrame, expected: DataFrame, high: int | None = None) -> int:
        """CHECKSUM_MISMATCH unless the rows of the round's keys are the same in `table` and `expected`; the number of changes that were read.
        The round counts only once it is committed: another one that was quicker makes it an error."""
        last, low, open_ = self.commits.entries()[-1], self.verified(), self.missing()
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self.fresh(log, high).select(CHANGE_ID, *columns(self.keys)).write.parquet(f"{folder}/changes")
        new = self.spark.read.parquet(f"{folder}/changes")
        new.groupBy(*columns(self.keys)).agg(F.min(CHANGE_ID).alias(CHANGE_ID)).write.parquet(f"{folder}/keys")
        first = self.spark.read.parquet(f"{folder}/keys")
        count, top = new.agg(F.count(F.lit(1)), F.coalesce(F.max(CHANGE_ID), F.lit(0))).first()
        window = F.floor((F.col(CHANGE_ID) - 1) / self.window).cast("long").alias("window_no")
        named = lambda side: first.alias("c").join(side.alias("t"), matches("c", "t", self.keys)).select(window, *columns(self.names, "t")).groupBy("window_no").agg(*sums(self.names, md5_prefix))
        require_equal(computed(compared(named(expected), named(table), "window_no", self.names)))
        came = new.where(F.col(CHANGE_ID) <= low).select(F.col(CHANGE_ID).alias("id"))
        still_missing(open_, came).unionByName(gap_ranges(new.where(F.col(CHANGE_ID) > low), low)).write.parquet(f"{folder}/missing")
        if not self.commits.claim(Commit(last.version + 1, uuid.uuid4().hex, 0, None, max(low, top), folder)):
            raise MigrationError("ASSERTION_ERROR", expected=f"round {last.version + 1}", got="a round of another writer")
        return count
