"""Change replay as set operations: one fold for each key in place of one statement for each change."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.errors import MigrationError
from tablewright.functions.columns import columns, matches, quoted
from tablewright.operators import groups as grouping
from tablewright.operators.capture import CHANGE_ID, DELETE, DML_TYPE, INSERT, UPDATE, of_type
from tablewright.operators.chunks import key_ranges, numbered


def delete_matching(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    gone = changes.where(of_type(DELETE)).select(*columns(keys)).distinct()
    return table.alias("t").join(gone.alias("c"), matches("t", "c", keys), "left_anti")


def update_matching(table: DataFrame, changes: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Columns other than the keys take the last update's values; keys without one stay."""
    rest = [c for c in changes.columns if c in table.columns and c not in keys]
    image = F.struct(*columns(rest))
    last = changes.where(of_type(UPDATE)).groupBy(*columns(keys)).agg(F.max_by(image, order if order is not None else F.col(CHANGE_ID)).alias("__image"), F.lit(True).alias("__hit"))
    joined = table.alias("t").join(last.alias("c"), matches("t", "c", keys), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__image.{quoted(c)}")).otherwise(F.col(f"t.{quoted(c)}")).alias(c) if c in rest else F.col(f"t.{quoted(c)}") for c in table.columns])


def insert_rows(table: DataFrame, changes: DataFrame, keys: list[str], ignore: bool = False) -> DataFrame:
    """ignore: the first row of a key wins, rows of the table first."""
    rows = changes.where(of_type(INSERT))
    if ignore:
        rows = rows.groupBy(*columns(keys)).agg(F.min_by(F.struct("*"), CHANGE_ID).alias("__row")).select("__row.*")
        rows = rows.alias("c").join(table.select(*columns(keys)).alias("t"), matches("c", "t", keys), "left_anti")
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), allowMissingColumns=True)


def folded(table: DataFrame, changes: DataFrame, keys: list[str], order: str = CHANGE_ID, fresh: dict[str, Column] | None = None) -> DataFrame:
    """What ordered replay leaves of a table with unique keys, with inserts that do not overwrite and updates that do not
    insert. Null keys match nothing and are not replayed.

    For each key: after its last delete, the first insert (or, never deleted, the table's row)
    is its birth; the last update after the birth gives its values. Columns that the log lacks
    keep the table's values; in new rows they have the value of `fresh`, or are null. All of a key's changes are two aggregates, which
    are partial before they are shuffled, and one join with the table."""
    known = functools.reduce(operator.and_, [F.col(quoted(k)).isNotNull() for k in keys])
    changes = changes.where(F.col(DML_TYPE).isin(INSERT, DELETE, UPDATE) & known)
    logged = [c for c in table.columns if c in changes.columns and c not in keys]
    image = F.struct(*columns(logged)) if logged else F.struct(F.lit(None).alias("none"))
    at = lambda kind: F.when(of_type(kind), F.col(order))
    seen = changes.groupBy(*columns(keys)).agg(F.max(at(DELETE)).alias("__deleted"), F.lit(True).alias("__seen"))
    live = changes.where(~of_type(DELETE)).alias("c").join(seen.alias("s"), matches("c", "s", keys)).where(F.col("__deleted").isNull() | (F.col(order) > F.col("__deleted"))).select("c.*")
    born = live.groupBy(*columns(keys)).agg(F.min(at(INSERT)).alias("__insert"), F.min_by(image, at(INSERT)).alias("__first"), F.max(at(UPDATE)).alias("__update"), F.max_by(image, at(UPDATE)).alias("__last"))
    state = seen.join(born, keys, "left")
    joined = table.withColumn("__there", F.lit(True)).alias("t").join(state.alias("f"), keys, "full_outer")
    from_table = F.col("__there").isNotNull() & F.col("__deleted").isNull()
    from_insert = ~from_table & F.col("__insert").isNotNull()
    updated = F.col("__update").isNotNull() & (from_table | (F.col("__update") > F.col("__insert")))
    value = lambda c: F.when(updated, F.col(f"__last.{quoted(c)}")).when(from_insert, F.col(f"__first.{quoted(c)}")).otherwise(F.col(f"t.{quoted(c)}"))
    own = lambda c: F.col(quoted(c)) if c in keys else value(c) if c in logged else F.when(~from_insert, F.col(f"t.{quoted(c)}")).otherwise((fresh or {}).get(c, F.lit(None)))
    return joined.where(F.col("__seen").isNull() | from_table | from_insert).select(*[own(c).alias(c) for c in table.columns])


def last_writer(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last change of each key: enough for logs whose every change fits its row."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*columns(keys)).agg(F.max_by(F.struct(*columns(rest)), CHANGE_ID).alias("__row"))
    return last.select(*columns(keys), "__row.*")


def violations(table: DataFrame, changes: DataFrame, keys: list[str], updates: bool = False) -> DataFrame:
    """Changes that fit no row: deletes (and updates, if asked) of absent and inserts of present keys, judged by the change of the same
    key before (or the table). Histories are cut into ranges of ids, so that no task orders all of a key's; what a range must know of
    those before comes from one row for each key and range."""
    low, high = changes.agg(F.min(CHANGE_ID), F.max(CHANGE_ID)).first()
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, -(-(high - low + 1) // parts)) if high is not None else 1
    cut = changes.withColumn("__range", F.floor((F.col(CHANGE_ID) - (low or 0)) / size))
    moves = F.when(of_type(INSERT), True).when(of_type(DELETE), False)
    ends = cut.groupBy(*columns(keys), "__range").agg(F.max_by(moves, F.when(moves.isNotNull(), F.col(CHANGE_ID))).alias("__end"))
    there = table.select(*columns(keys)).withColumn("__there", F.lit(True))
    held = ends.alias("c").join(there.alias("t"), matches("c", "t", keys), "left").select("c.*", F.col("__there").isNotNull().alias("__there"))
    earlier = Window.partitionBy(*columns(keys)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows of a key at most
    states = held.select(*columns(keys), "__range", F.coalesce(F.last("__end", ignorenulls=True).over(earlier), F.col("__there")).alias("__begins"))
    same = functools.reduce(operator.and_, [F.col(f"c.{quoted(k)}").eqNullSafe(F.col(f"s.{quoted(k)}")) for k in [*keys, "__range"]])
    joined = cut.alias("c").join(states.alias("s"), same).select("c.*", "__begins")
    before = Window.partitionBy(*columns(keys), "__range").orderBy(CHANGE_ID).rowsBetween(Window.unboundedPreceding, -1)
    judged = joined.withColumn("__state", F.coalesce(F.last(moves, ignorenulls=True).over(before), F.col("__begins")))
    absent = of_type(DELETE) | of_type(UPDATE) if updates else of_type(DELETE)
    return judged.where((absent & ~F.col("__state")) | (of_type(INSERT) & F.col("__state"))).drop("__begins", "__state", "__range")


def require_effect(table: DataFrame, changes: DataFrame, keys: list[str], keep_in: str | None = None) -> None:
    """Strict replay: REPLAY_WRONG_AFFECTED where a delete finds no row or an insert finds one. keep_in: a folder for these changes."""
    odd = violations(table, changes, keys)
    if count := odd.count():
        if keep_in:
            odd.write.parquet(keep_in)
        raise MigrationError("REPLAY_WRONG_AFFECTED", count=count)


def require_known_types(changes: DataFrame) -> None:
    odd = changes.where(~F.col(DML_TYPE).isin(INSERT, DELETE, UPDATE)).select(DML_TYPE).limit(1).collect()
    if odd:
        raise MigrationError("UNKNOWN_REPLAY_TYPE", dml_type=odd[0][0])


def change_groups(changes: DataFrame, size: int, grouped_updates: bool = False, keys: list[str] | None = None) -> DataFrame:
    """group_no, dml_type, first_id, last_id, n: runs of one type in id order, of `size` at most; updates stand
    alone, or, grouped, no group has two updates of one key (keys are asked for then). Runs are found inside ranges of ids; what a range must
    know of those before (the last type, where the run began, its rows so far) comes from one row for each range."""
    if grouped_updates and keys:
        return grouping.change_groups(changes, size, keys)
    log = changes.select(CHANGE_ID, DML_TYPE)
    ranges = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    log = log.withColumn("__range", key_ranges(log, [CHANGE_ID], ranges))
    by_id, by_range = Window.partitionBy("__range").orderBy(CHANGE_ID), Window.orderBy("__range")
    ends = log.groupBy("__range").agg(F.max_by(DML_TYPE, CHANGE_ID).alias("__last"))  # at most `ranges` rows, as are all with by_range
    known = log.join(F.broadcast(ends.select("__range", F.lag("__last").over(by_range).alias("__before"))), "__range")
    alone = of_type(UPDATE) if not grouped_updates else F.lit(False)
    starts = alone | ~F.col(DML_TYPE).eqNullSafe(F.coalesce(F.lag(DML_TYPE).over(by_id), "__before"))
    marked = known.select("__range", CHANGE_ID, DML_TYPE, F.row_number().over(by_id).alias("__no"), starts.alias("__starts"))
    own = F.last(F.when(F.col("__starts"), F.struct(F.col(CHANGE_ID).alias("run"), F.col("__no").alias("no"))), ignorenulls=True)
    placed = marked.withColumn("__own", own.over(by_id))
    tails = placed.groupBy("__range").agg(F.max("__own").alias("__own"), F.count(F.lit(1)).alias("__n"))
    tails = tails.select("__range", F.last("__own.run", ignorenulls=True).over(by_range).alias("__run"), (F.col("__n") - F.coalesce(F.col("__own.no") - 1, F.lit(0))).alias("__tail"))
    so_far = F.sum("__tail").over(Window.partitionBy("__run").orderBy("__range"))
    tails = tails.withColumn("__so_far", so_far).select("__range", F.lag("__run").over(by_range).alias("__run"), F.lag("__so_far").over(by_range).alias("__so_far"))
    place = F.col("__no") - F.coalesce("__own.no", 1 - F.col("__so_far"))
    runs = placed.join(F.broadcast(tails), "__range").select(CHANGE_ID, DML_TYPE, F.coalesce("__own.run", "__run").alias("__run"), F.floor(place / size).alias("__part"))
    groups = runs.groupBy("__run", "__part").agg(F.min(DML_TYPE).alias(DML_TYPE), F.min(CHANGE_ID).alias("first_id"), F.max(CHANGE_ID).alias("last_id"), F.count(F.lit(1)).alias("n"))
    return numbered(groups, ["first_id"], "group_no").select(F.col("group_no").cast("long"), DML_TYPE, "first_id", "last_id", "n")


def counts_by_type(changes: DataFrame) -> DataFrame:
    return changes.groupBy(DML_TYPE).agg(F.count(F.lit(1)).alias("n"))
