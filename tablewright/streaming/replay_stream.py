"""Replay of a change stream: micro-batches of change files are folded into versions of the table.

The table lies in buckets of its keys; a batch writes only the buckets that it touches, and a version is
the list of the buckets' folders. Late ids (gaps) are applied before new ones of the same batch and after all earlier batches;
an id that was seen is an error, unless the batch itself is a repeat: one of the same writer (a stream's checkpoint, a replay
of ranges) and of the same number. A version is written aside and exists only once its commit is in place; a writer whose
place was taken starts again on top of the version that took it, so no batch is lost and none is half there. Gap state
is kept as id ranges in each version's folder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import MigrationError
from tablewright.functions.columns import columns, md5_prefix
from tablewright.operators.capture import CHANGE_ID, by_ids, in_range, last_id
from tablewright.operators.gaps import CELL, gap_ranges, in_ranges, still_missing
from tablewright.operators.replay import folded, require_known_types
from tablewright.operators.verify import by_change_window, compared, require_equal
from tablewright.streaming.commits import Commit, CommitLog, stream_id


class ReplayTarget:
    """Versions of a table under `path`: commits/<version>.json and a folder in data/ for each: table (the buckets that changed), buckets (in which
    version each bucket was last written), state (last id and missing ranges)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], max_changes: int = 2_146_483_647, buckets: int = 64, attempts: int = 20):
        self.spark, self.path, self.keys, self.max_changes, self.buckets, self.attempts = spark, path, keys, max_changes, buckets, attempts
        self.commits = CommitLog(spark, f"{path}/commits")

    def start(self, base: DataFrame, last_id: int = 0, seen: DataFrame | None = None) -> None:
        """Version -1: a snapshot that has all changes up to last_id; seen: the ids (change_id) that it has, so that the holes
        between them are gaps, whose changes are still to come."""
        base.limit(0).write.mode("error").parquet(f"{self.path}/schema")
        folder = self._fresh()
        self._write(base, -1, folder, {}, range(self.buckets))
        gaps_left = gap_ranges(seen.where(F.col(CHANGE_ID) <= last_id)).select(F.lit(last_id).cast("long").alias("last_id"), "first", "last") if seen is not None else None
        state = self._state([(last_id, None, None)])
        (state if gaps_left is None else state.unionByName(gaps_left)).write.parquet(f"{folder}/state")
        self.commits.claim(Commit(-1, "start", 0, None, last_id, folder))

    def _fresh(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def _bucketed(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("__bucket", F.pmod(F.xxhash64(*columns(self.keys)), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, version: int, folder: str, before: dict[int, int], touched: Iterable[int]) -> None:
        """The touched buckets' rows, and where all buckets lie now."""
        self._bucketed(rows).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/table")
        lie = before | {b: version for b in touched}
        listed = [(b, v) for b, v in sorted(lie.items()) if v != version or self._exists(f"{folder}/table/__bucket={b}")]
        self.spark.createDataFrame(listed, "bucket int, version int").coalesce(1).write.parquet(f"{folder}/buckets")

    def _exists(self, path: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def _folder(self, version: int) -> str:
        return next(c.folder for c in self.commits.entries() if c.version == version)

    def lie(self, version: int) -> dict[int, int]:
        """The version in which each bucket that has rows was last written."""
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self._folder(version)}/buckets").collect()}

    def _read(self, lie: dict[int, int]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        folders = {c.version: c.folder for c in self.commits.entries()}
        paths = [f"{folders[v]}/table/__bucket={b}" for b, v in sorted(lie.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def prune(self, keep: int = 2) -> list[int]:
        """Delete the versions that none of the last `keep` ones needs; their numbers. Commits stay, as repeats are told by them."""
        done = self.commits.entries()
        needed = {v for last in done[-keep:] for v in (last.version, *self.lie(last.version).values())}
        jvm, gone = self.spark.sparkContext._jvm, [c for c in done if c.version not in needed and self._exists(c.folder)]
        for c in gone:
            folder = jvm.org.apache.hadoop.fs.Path(c.folder)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return [c.version for c in gone]

    def _state(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, "last_id long, first long, last long").coalesce(1)

    def versions(self) -> list[int]:
        return [c.version for c in self.commits.entries() if self._exists(c.folder)]

    def table(self, version: int | None = None) -> DataFrame:
        return self._read(self.lie(self.commits.entries()[-1].version if version is None else version))

    def state(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(version)}/state")

    def last_id(self) -> int:
        return self.state(self.commits.entries()[-1].version).agg(F.max("last_id")).first()[0]

    def apply(self, batch: DataFrame, batch_id: int, writer: str = "") -> int | None:
        """Fold a batch into the next version and return its number; a repeated batch (the same writer and number) changes nothing."""
        batch = batch.persist()  # read several times below
        try:
            for _ in range(self.attempts):
                done = self.commits.entries()
                if any((c.writer, c.batch) == (writer, batch_id) for c in done):
                    return None
                commit = self._applied(batch, batch_id, writer, done[-1].version)
                if self.commits.claim(commit):
                    return commit.version
        finally:
            batch.unpersist()
        raise MigrationError("MAX_ATTEMPT_EXCEEDED", attempts=self.attempts)

    def _applied(self, batch: DataFrame, batch_id: int, writer: str, before: int) -> Commit:
        """The version after `before`, written to a folder of its own but not yet committed."""
        require_known_types(batch)
        state = self.state(before)
        last = state.agg(F.max("last_id")).first()[0]
        missing = state.where("first IS NOT NULL").select("first", "last")
        late = batch.where(F.col(CHANGE_ID) <= last).select(F.col(CHANGE_ID).alias("id"))
        cells = missing.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor(F.col("last") / CELL))))
        seen = late.withColumn("late_cell", F.floor(F.col("id") / CELL))
        inside = (F.col("late_cell") == F.col("cell")) & F.col("id").between(F.col("first"), F.col("last"))
        if seen.join(cells, inside, "left_anti").limit(1).count():
            raise MigrationError("ASSERTION_ERROR", expected=f"ids over {last} or missing ones", got="ids that were seen")
        bottom, top = batch.agg(F.min(CHANGE_ID), F.max(CHANGE_ID)).first()
        if (top or 0) > self.max_changes:
            raise MigrationError("REPLAY_TOO_MANY_DELTAS", count=top, limit=self.max_changes)
        folder, version = self._fresh(), before + 1
        ordered = batch.withColumn("__order", F.when(F.col(CHANGE_ID) <= last, F.col(CHANGE_ID)).otherwise(F.col(CHANGE_ID) + F.lit(1 << 62)))
        touched = {r[0] for r in self._bucketed(batch.select(*columns(self.keys))).select("__bucket").distinct().collect()}  # at most `buckets` rows
        lie = self.lie(before)
        self._write(folded(self._read({b: v for b, v in lie.items() if b in touched}), ordered, self.keys, "__order"), version, folder, lie, touched)
        left = still_missing(missing, late).unionByName(gap_ranges(batch, last))
        now = F.lit(max(last, top or 0)).cast("long")
        none = F.lit(None).cast("long")
        left.select(now.alias("last_id"), "first", "last").unionByName(self.spark.range(1).select(now.alias("last_id"), none.alias("first"), none.alias("last"))).write.parquet(f"{folder}/state")
        return Commit(version, writer, batch_id, bottom, top, folder)


LEAST_RANGE = 500_000


def replay_ranges(log: DataFrame, target: ReplayTarget, size: int | None = None) -> int:
    """Replay a stored log in ranges of at most `size` ids after the target's last one, so that no batch holds a whole backlog; the
    number of ranges. Each range is a version, numbered on. A range writes the buckets that it touches again, which are mostly all, so
    without a size it has as many ids as the table has rows (LEAST_RANGE at least): what is written grows with the log, not with log times table."""
    low, high = target.last_id(), last_id(log).first()[0]
    size = size or max(LEAST_RANGE, target.table().count())
    writer = f"ranges-{uuid.uuid4().hex}"  # what is left after a failure is another replay, from the last id that is there
    for n, start in enumerate(range(low, high, size)):
        target.apply(in_range(log, start, min(start + size, high)), n, writer)
    return max(0, -(-(high - low) // size))


def final_replay(log: DataFrame, target: ReplayTarget, ceiling: int | None = None) -> int | None:
    """Everything that is left of a stored log, missing ids that have come included, as one version: all of it or nothing. Its number."""
    version = target.commits.entries()[-1].version
    low = target.last_id()
    open_ = target.state(version).where("first IS NOT NULL").select("first", "last")
    fresh = in_range(log, low, ceiling)
    filled = by_ids(log, in_ranges(log.where(F.col(CHANGE_ID) <= low).select(CHANGE_ID), open_))
    rest = fresh.unionByName(filled)
    return target.apply(rest, 0, f"final-{uuid.uuid4().hex}") if rest.limit(1).count() else None


def replay_available(changes: DataFrame, target: ReplayTarget, checkpoint: str) -> None:
    """One round: all change files that are there, then stop. The stream's id, kept in its checkpoint, is the writer."""

    def apply(batch: DataFrame, number: int) -> None:
        target.apply(batch, number, f"stream-{stream_id(target.spark, checkpoint)}")

    changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def verify_changes(target: ReplayTarget, expected: DataFrame, log: DataFrame, names: list[str], low: int = 0, high: int | None = None, size: int = 500) -> None:
    """CHECKSUM_MISMATCH unless the rows of all keys that were first changed in a window of ids are the same in the target and in
    `expected`: what is left to verify after a whole comparison."""
    sums = lambda table: by_change_window(table, log, target.keys, names, low, high, size, md5_prefix)
    require_equal(compared(sums(expected), sums(target.table()), "window_no", names))


def catch_up(changes: DataFrame, target: ReplayTarget, checkpoint: str, seconds: float = 5.0, attempts: int = 15) -> int:
    """Rounds until one is quick enough for the final one to be short; the number of rounds."""
    for attempt in range(1, attempts + 1):
        began = time.monotonic()
        replay_available(changes, target, checkpoint)
        if time.monotonic() - began < seconds:
            return attempt
    raise MigrationError("MAX_ATTEMPT_EXCEEDED", attempts=attempts)
