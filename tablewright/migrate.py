"""A migration from start to end: check, copy, replay, verify, swap, clean up, with hooks."""

from __future__ import annotations

import hashlib
import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.cleanup import CleanUp
from tablewright.errors import MigrationError
from tablewright.functions.columns import checked_columns, columns, matches, md5_prefix, quoted
from tablewright.operators import chunks, replay, tree, uniques, verify
from tablewright.operators.stats import RunStats
from tablewright.plans.checks import dump_keys, identity, require_migratable, require_no_foreign_keys, require_space, verification
from tablewright.plans.diff import SchemaDiff, converted_columns
from tablewright.plans.schema import ColumnSpec, TableSpec, same_schema
from tablewright.sources.shared import computed
from tablewright.sources.tables import fingerprint, require_database, require_unchanged, scan, size

PREFIXES = {"new": "__tw_new_", "old": "__tw_old_"}


LONGEST_NAME = 64  # fixed value: of an object's name


def beside(prefix: str, table: str) -> str:
    """The name of an object beside a table: prefix and name, or, where that is too long, a part of the name and a digest of all of it."""
    name = prefix + table
    if len(name) <= LONGEST_NAME:
        return name
    digest = hashlib.sha256(table.encode()).hexdigest()[:12]
    return f"{prefix}{table[: LONGEST_NAME - len(prefix) - 13]}_{digest}"


def dump_table(table: DataFrame, old: TableSpec, new: TableSpec, path: str, chunk_bytes: int = 2 << 20) -> list[str] | None:
    """Write a table for `chunks.load` in the way that its size and keys allow: chunks of so many bytes by key, or as it lies. What it was cut by."""
    keys = dump_keys(old, new, identity(old, True)[0], size(table)[1])
    chunks.dump(table, keys, rows_of_files(table, chunk_bytes) if keys else 1, path)
    return keys


def untouched(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys no change has."""
    return table.alias("t").join(changes.select(*columns(keys)).distinct().alias("c"), matches("t", "c", keys), "left_anti")


def rows_of_files(table: DataFrame, chunk_bytes: int) -> int:
    """Rows of a chunk of so many bytes, by the table's files: their length from a listing, their rows from the files' footers, which is all that
    a count without columns reads."""
    total = size(table)[1]
    count = table.count()
    return chunks.rows_per_chunk(chunk_bytes, total // max(1, count))


def default_value(c: ColumnSpec) -> F.Column:
    """Of a column that the old table lacks: what its DEFAULT says; without one, the zero of its type where null is not allowed."""
    if c.default is None or c.default.upper() == "NULL":
        if c.nullable:
            return F.lit(None)
        kind = c.spark_type()
        return F.lit("") if isinstance(kind, (T.StringType, T.BinaryType)) else F.lit(0) if isinstance(kind, T.NumericType) else F.lit(False) if isinstance(kind, T.BooleanType) else F.lit(None)
    if c.default.upper().startswith("CURRENT_TIMESTAMP"):
        return F.current_timestamp()
    if m := re.fullmatch(r"[bB]'([01]*)'", c.default):
        return F.lit(int(m[1] or "0", 2))
    return F.lit(re.sub(r"''|\\(.)", lambda m: m[1] or "'", c.default[1:-1]) if c.default[:1] == "'" else c.default)


def copied(frame: DataFrame, new: TableSpec) -> DataFrame:
    """The rows in the new schema: kept columns cast (strictly, in ANSI mode), new ones by their default."""
    return frame.select(*[(F.col(quoted(c.name)) if c.name in frame.columns else default_value(c)).cast(c.spark_type()).alias(c.name) for c in new.columns])


def first_of_duplicates(frame: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """One row for each unique key: the first in order."""
    picked = F.min_by(F.struct("*"), F.struct(*[F.col(quoted(o)) for o in order])).alias("__row")
    return frame.groupBy(*[F.col(quoted(u)) for u in unique]).agg(picked).select("__row.*")


def require_same_types(frame: DataFrame, new: TableSpec) -> None:
    """IMPLICIT_CONVERSION_DETECTED where the new table's columns are not what was declared, in name, order or type."""
    declared, made = [(f.name, f.dataType) for f in new.struct()], [(f.name, f.dataType) for f in frame.schema]
    if odd := [x for x in zip(declared, made, strict=False) if x[0] != x[1]] or ([(declared, made)] if len(declared) != len(made) else []):
        raise MigrationError("IMPLICIT_CONVERSION_DETECTED", difference=f"{odd[0][0]} became {odd[0][1]}")


@dataclass
class Migration:
    """Stages in order, each computed before the next begins, with hooks before and after it and its seconds.

    where: a filter of the rows to copy; changes are replayed as they are, and no checksums are compared, as the old table has more. strict: a change that fits no
    row is an error (keep_failed_in: a folder for such changes). verify: a mismatch is an error (always so before a swap, but for
    swap_unverified). seconds_limit: of the replay. ceiling: changes with larger ids are left alone.
    foreign: foreign keys (rows of sources.tables.foreign_keys), none of which may touch the table. free_bytes: of the store, checked against the
    table's size. eliminate_dups: of rows that agree in a unique key of the new schema the first ones stay; else such rows are an error.
    chunk_rows: of a comparison's chunks; None: by chunk_bytes and the bytes of a row in the table's files. force_cleanup: what an earlier migration left is dropped first."""

    old: TableSpec
    new: TableSpec
    allow_drop: bool = False
    chunk_rows: int | None = 999
    chunk_bytes: int = 2 << 20
    hooks: dict[str, Callable[[], None]] = field(default_factory=dict)
    critical: bool = True
    where: str | None = None
    strict: bool = False
    verify: bool = False
    rebuild: bool = False
    keep_old: bool = False
    seconds_limit: float | None = None
    keep_failed_in: str | None = None
    swap_unverified: bool = False
    ceiling: int | None = None
    foreign: DataFrame | None = None
    free_bytes: int | None = None
    eliminate_dups: bool = False
    force_cleanup: bool = False
    skip_columns: str = ""
    stats: RunStats = field(default_factory=RunStats)
    seconds: dict[str, float] = field(default_factory=dict)

    def stage(self, name: str, work: Callable[[], Any]) -> Any:
        self.hook(f"before_{name}")
        began = time.monotonic()
        out = work()
        out = computed(self.stats.watched(name, out)) if isinstance(out, DataFrame) else out
        self.seconds[name] = time.monotonic() - began
        self.stats.took(name, self.seconds[name])
        self.hook(f"after_{name}")
        return out

    def hook(self, name: str) -> None:
        try:
            self.hooks.get(name, lambda: None)()
        except Exception as e:
            if self.critical:
                raise MigrationError("OUTSIDE_HOOK_ERROR", hook=name, message=str(e)) from e

    def replayed(self, copy: DataFrame, changes: DataFrame, keys: list[str], spent: float = 0.0) -> DataFrame:
        replay.require_known_types(changes)
        if self.strict and not self.where:
            replay.require_effect(copy, changes, keys, self.keep_failed_in)
        kept = [c for c in changes.columns if c in (replay.CHANGE_ID, replay.DML_TYPE) or self.new.column(c)]
        typed = [F.col(quoted(c)).cast(self.new.column(c).spark_type()).alias(c) if self.new.column(c) else F.col(quoted(c)) for c in kept]
        defaults = {c.name: default_value(c).cast(c.spark_type()) for c in self.new.columns if c.name not in kept}
        out = replay.folded(copy, changes.select(*typed), keys, fresh=defaults)
        return out if self.seconds_limit is None else in_time(out, max(0.001, self.seconds_limit - spent))

    def run(self, table: DataFrame, changes: DataFrame, expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The migrated table, and the comparison of its chunks with those of what it should be: `expected`, a reading of the old table
        after the changes, or, for want of one, what `expected_rows` knows; where that is nothing, only rows that no change touches are compared."""
        none = table.sparkSession.createDataFrame([], "chunk_id long, cnt_old long, cnt_new long, mismatched string")
        if same_schema(self.old, self.new) and not self.rebuild:
            return table, none
        keys = self.stage("check", lambda: require_migratable(self.old, self.new, self.allow_drop, table_bytes=size(table)[1] or None))
        copy = self.stage("copy", lambda: copied(scan(table, table.columns, self.where), self.new))
        require_same_types(copy, self.new)

        def replayed() -> DataFrame:
            nonlocal changes  # read several times from here on: what makes the log runs once, and all readings see the same changes
            began = time.monotonic()
            changes = computed(changes) if self.seconds_limit is None else in_time(changes, self.seconds_limit)
            return self.replayed(copy, changes, keys, time.monotonic() - began)

        new = self.stage("replay", replayed)
        way = verification(self.old, self.new, keys, self.where)
        if way == "none":
            return new, none
        target, compared_new = self.expected_rows(table, changes, keys, expected), new
        if target is None:  # only rows that no change touches are known from elsewhere
            target = untouched(table, changes, keys)
            compared_new = untouched(new, changes, keys)
        shared = [c for c in checked_columns(new, self.skipped(keys)) if c in table.columns]
        rows = self.chunk_rows or rows_of_files(table, self.chunk_bytes)
        if way == "chunks":
            checks = self.stage("verify", lambda: tree.differing_chunks(copied(target, self.new), compared_new, keys, shared, rows, hashed=md5_prefix).select("chunk_id", "cnt_old", "cnt_new", "mismatched"))
        else:
            whole = lambda frame: verify.whole(frame, shared, md5_prefix).withColumn("chunk_id", F.lit(0).cast("long"))
            checks = self.stage("verify", lambda: verify.compared(whole(copied(target, self.new)), whole(compared_new), "chunk_id", shared))
        if self.verify:
            verify.require_equal(checks)
        return new, checks

    def skipped(self, keys: list[str]) -> list[str]:
        """Columns that are not compared: `modified` ones (whose type changes), `keys`, or none."""
        if self.skip_columns == "modified":
            return converted_columns(self.old, self.new)
        return keys if self.skip_columns == "keys" else []

    def expected_rows(self, table: DataFrame, changes: DataFrame, keys: list[str], expected: DataFrame | None) -> DataFrame | None:
        """What the old table should read like after the changes, known in another way than by the fold: `expected`, a reading of it; or, for
        want of one, its rows that no change touches and the last image of the others, if each change fits its row. Else None."""
        if expected is not None:
            return expected
        if not self.fits(table, changes, keys):
            return None
        known = changes.where(verify.all_known(keys))  # null keys are not replayed
        last = replay.last_writer(known, keys).where(F.col(replay.DML_TYPE) != replay.DELETE)
        born = known.where(replay.of_type(replay.INSERT)).select(*columns(keys)).distinct().withColumn("__born", F.lit(True)).alias("b")
        logged = [c for c in table.columns if c in changes.columns]
        old = table.select(*columns(keys), *columns([c for c in table.columns if c not in logged])).alias("t")
        there = last.alias("c").join(old, matches("c", "t", keys), "left").join(born, matches("c", "b", keys), "left")

        def value(c: str) -> F.Column:
            """From the log; of what it lacks, the table's value, or in a row that was inserted since the new schema's default."""
            if c in logged:
                return F.col(f"c.{quoted(c)}")
            spec = self.new.column(c)
            default = default_value(spec).cast(table.schema[c].dataType) if spec else F.lit(None)
            return F.when(F.col("__born"), default).otherwise(F.col(f"t.{quoted(c)}"))

        return untouched(table, changes, keys).unionByName(there.select(*[value(c).alias(c) for c in table.columns]))

    def fits(self, table: DataFrame, changes: DataFrame, keys: list[str]) -> bool:
        """Whether every change fits its row, so that the last one of a key says what becomes of it."""
        return not self.where and not replay.violations(table, changes, keys, updates=True).limit(1).count()

    def require_safe(self, spark: SparkSession, table: str) -> int:
        """The checks before anything is made; the fingerprint of the table's files."""
        if "." in table:
            require_database(spark, table.split(".")[0].strip("`"))
        if not spark.catalog.tableExists(table):
            raise MigrationError("TABLE_NOT_EXIST", table=table)
        if self.foreign is not None:
            require_no_foreign_keys(self.foreign, self.old.name)
        if self.free_bytes is not None:
            require_space(size(spark.table(table))[1], self.free_bytes, not self.old.primary)
        if self.force_cleanup:
            clean_up(spark, table)
        return fingerprint(spark.table(table))

    def run_table(self, spark: SparkSession, table: str, changes: DataFrame, expected: DataFrame | None = None) -> str | None:
        """Migrate a table of the catalog: write the new one beside it, compare what was written, swap the names and drop the old one unless it is to be
        kept (then its new name is returned). Nothing is swapped that was not found equal: to `expected`, or, where every change fits
        its row, to what is known without it; swap_unverified=True asks for a swap all the same. What was made is dropped if
        anything fails, and so it is if the table's files change meanwhile."""
        before = self.require_safe(spark, table)
        fresh, away = beside(PREFIXES["new"], table), beside(PREFIXES["old"], table)
        if left := [t for t in (fresh, away) if spark.catalog.tableExists(t)]:
            raise MigrationError("TABLE_ALREADY_EXIST", table=left[0])
        if self.ceiling is not None:
            changes = changes.where(F.col(replay.CHANGE_ID) <= self.ceiling)
        if same_schema(self.old, self.new) and not self.rebuild:
            return None
        known = None if self.where else self.expected_rows(spark.table(table), changes, identity(self.old, True)[0], expected)
        if known is None and not self.swap_unverified:
            raise MigrationError("UNVERIFIED_SWAP", table=table)
        made = CleanUp(spark)
        made.tables.append(fresh)
        try:
            new, checks = self.run(spark.table(table), changes, known)
            if not self.swap_unverified:
                verify.require_equal(checks)
            new = self.without_duplicates(new)
            new.write.saveAsTable(fresh)
            written = spark.table(fresh)
            require_same_types(written, self.new)
            if not self.swap_unverified:
                verify.require_same_rows(new, written)
            spark.sql(f"ANALYZE TABLE {quoted(fresh)} COMPUTE STATISTICS")
            require_unchanged(spark.table(table), before)
            self.stage("swap", lambda: swap_tables(spark, table, fresh))
            made.forget(fresh)
            if not self.keep_old:
                made.tables.append(away)
        finally:
            made.run()
        return away if self.keep_old else None

    def without_duplicates(self, new: DataFrame) -> DataFrame:
        """The rows, if the unique keys of the new schema hold; of rows that break one the first are kept (eliminate_dups), in the order of the primary key."""
        unique = [k.names() for k in [self.new.primary, *self.new.keys] if k and (k is self.new.primary or k.unique)]
        if self.eliminate_dups:
            return computed(uniques.accepted(new, unique, self.new.primary.names()))
        for names in unique:
            if found := verify.duplicates(new.where(verify.all_known(names)), names).limit(1).collect():
                raise MigrationError("DUPLICATE_KEY", columns=", ".join(names), value=tuple(found[0])[:-1])
        return new

    def diff(self) -> SchemaDiff:
        return SchemaDiff(self.old, self.new)


def in_time(frame: DataFrame, seconds: float) -> DataFrame:
    """The frame, computed; its jobs are cancelled, and REPLAY_TIMEOUT raised, when that takes longer."""
    sc, group = frame.sparkSession.sparkContext, f"replay-{uuid.uuid4().hex}"
    late = threading.Event()
    timer = threading.Timer(seconds, lambda: (late.set(), sc.cancelJobGroup(group)))
    sc.setJobGroup(group, "replay with a time limit", True)
    timer.start()
    try:
        out = computed(frame)
    except Exception as e:
        if late.is_set():
            raise MigrationError("REPLAY_TIMEOUT", seconds=seconds) from e
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
    if late.is_set():
        raise MigrationError("REPLAY_TIMEOUT", seconds=seconds)
    return out


def asserting(spark: SparkSession, sql: str, expected: list[tuple]) -> Callable[[], None]:
    """A hook: ASSERTION_ERROR unless the query returns these rows, in order."""

    def hook() -> None:
        got = [tuple(r) for r in spark.sql(sql).collect()]
        if got != expected:
            raise MigrationError("ASSERTION_ERROR", expected=expected, got=got)

    return hook


def swap_tables(spark: SparkSession, table: str, fresh: str) -> str:
    """Rename the table away and the fresh one in; undo the first rename if the second fails. The old table's new name."""
    if not spark.catalog.tableExists(table):
        raise MigrationError("TABLE_NOT_EXIST", table=table)
    if not spark.catalog.tableExists(fresh):
        raise MigrationError("TABLE_NOT_EXIST", table=fresh)
    away = beside(PREFIXES["old"], table)
    spark.sql(f"ALTER TABLE {quoted(table)} RENAME TO {quoted(away)}")
    try:
        spark.sql(f"ALTER TABLE {quoted(fresh)} RENAME TO {quoted(table)}")
    except Exception:
        spark.sql(f"ALTER TABLE {quoted(away)} RENAME TO {quoted(table)}")
        raise
    return away


def clean_up(spark: SparkSession, table: str | None = None) -> list[str]:
    """Drop what migrations (of one table) left behind; the names."""
    mine = tuple(PREFIXES.values()) if table is None else tuple(beside(p, table) for p in PREFIXES.values())
    left = [t.name for t in spark.catalog.listTables() if (t.name.startswith(mine) if table is None else t.name in mine)]
    for name in left:
        spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
    return left


__all__ = ["Migration", "asserting", "chunks", "clean_up", "copied", "dump_table", "first_of_duplicates", "swap_tables"]
