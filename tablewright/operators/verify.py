"""Checksums of old and new data: whole, by chunk, by window of changes, and down to rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import MigrationError
from tablewright.functions.columns import checked_columns, columns, crc, matches, quoted, xor_of
from tablewright.operators.capture import CHANGE_ID, in_range
from tablewright.operators.chunks import chunked


def sums(names: list[str], hashed: Callable[[str], Column] = crc) -> list[Column]:
    return [F.count(F.lit(1)).alias("cnt"), *[xor_of(hashed(c)).alias(c) for c in names]]


def whole(frame: DataFrame, names: list[str], hashed: Callable[[str], Column] = crc) -> DataFrame:
    return frame.agg(*sums(names, hashed))


def strong(frame: DataFrame, names: list[str]) -> DataFrame:
    """One number that pairs of equal rows do not cancel in. As the hash passes nulls over, each value goes in after whether it is null."""
    told = [x for c in columns(sorted(names)) for x in (c.isNull(), c)]
    return frame.agg(F.coalesce(F.sum(F.xxhash64(*told).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def by_chunk(frame: DataFrame, keys: list[str], rows: int, names: list[str], hashed: Callable[[str], Column] = crc) -> DataFrame:
    return chunked(frame, keys, rows).groupBy("chunk_id").agg(*sums(names, hashed))


def first_touches(log: DataFrame, keys: list[str]) -> DataFrame:
    """The first change of every key in the whole log."""
    first = log.groupBy(*columns(keys)).agg(F.min_by(F.struct("*"), CHANGE_ID).alias("__row"))
    return first.select("__row.*")


def by_change_window(table: DataFrame, log: DataFrame, keys: list[str], names: list[str], low: int, high: int | None, size: int, hashed: Callable[[str], Column] = crc) -> DataFrame:
    """window_no, cnt and checksums of the table's rows whose keys were first changed in each window of ids, to the end of the log if high is None."""
    touched = in_range(first_touches(log, keys), low, high).select(F.floor((F.col(CHANGE_ID) - 1 - low) / size).cast("long").alias("window_no"), *columns(keys))
    joined = touched.alias("c").join(table.alias("t"), matches("c", "t", keys), "left").select("window_no", *[F.col(f"t.{quoted(n)}") for n in names])
    return joined.groupBy("window_no").agg(*sums(names, hashed))


def compared(old: DataFrame, new: DataFrame, by: str, names: list[str]) -> DataFrame:
    """by, cnt_old, cnt_new, mismatched (names of the columns whose checksums differ) of every part that differs."""
    both = old.alias("o").join(new.alias("n"), by, "full_outer")
    odd = F.filter(F.array(*[F.when(~F.col(f"o.{quoted(c)}").eqNullSafe(F.col(f"n.{quoted(c)}")), F.lit(c)) for c in names]), lambda c: c.isNotNull())
    out = both.select(by, F.coalesce("o.cnt", F.lit(0)).cast("long").alias("cnt_old"), F.coalesce("n.cnt", F.lit(0)).cast("long").alias("cnt_new"), F.array_join(odd, ",").alias("mismatched"))
    return out.where((F.col("cnt_old") != F.col("cnt_new")) | (F.col("mismatched") != ""))


def fingerprint(checks: DataFrame, names: list[str]) -> DataFrame:
    """All checksums and counts of all parts, XORed."""
    row = functools.reduce(lambda a, b: a.bitwiseXOR(b), [F.col(quoted(c)) for c in ["cnt", *names]])
    return checks.agg(F.coalesce(F.bit_xor(row), F.lit(0).cast("long")).alias("fingerprint"))


def require_equal(differences: DataFrame) -> None:
    """CHECKSUM_MISMATCH with the first part that differs, if any does (rows of `compared`)."""
    found = differences.orderBy(differences.columns[0]).limit(1).collect()
    if found:
        part, old, new, names = found[0]
        raise MigrationError("CHECKSUM_MISMATCH", difference=f"{differences.columns[0]} {part}: {old} and {new} rows, columns {names or 'none'}")


def all_known(names: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [c.isNotNull() for c in columns(names)])


def require_same_rows(made: DataFrame, written: DataFrame) -> None:
    """CHECKSUM_MISMATCH unless what was written reads as what was made: the number of rows and a strong checksum over every column that one can be made of."""
    names = checked_columns(made)
    sums = [frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[x for c in columns(sorted(names)) for x in (c.isNull(), c)]).cast("decimal(38,0)"))).first() for frame in (made, written)]
    if sums[0] != sums[1]:
        raise MigrationError("CHECKSUM_MISMATCH", difference=f"written rows: {sums[0][0]} and {sums[1][0]} rows, checksums {sums[0][1]} and {sums[1][1]}")


def duplicates(frame: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: what would break a unique key."""
    return frame.groupBy(*columns(keys)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def strong_portable(frame: DataFrame, names: list[str]) -> DataFrame:
    """As `strong`, with a hash that other engines have: the sum over all rows of the prefix of one MD5 of the row. Null and empty
    differ, and so do values that only together are equal."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.hex(F.col(quoted(c)).cast("string").cast("binary"))), F.lit("-"))
    row = F.conv(F.substring(F.md5(F.concat_ws(",", *[text(c) for c in sorted(names)]).cast("binary")), 1, 15), 16, 10)
    return frame.agg(F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").alias("checksum"))


def write_differing(old: DataFrame, new: DataFrame, keys: list[str], rows: int, differences: DataFrame, path: str) -> None:
    """Write all rows of the chunks that differ (rows of `compared`, by chunk_id), those of either side in folders of their own."""
    side = lambda frame, name: chunked(frame, keys, rows).join(differences.select("chunk_id"), "chunk_id", "left_semi").withColumn("side", F.lit(name))
    side(old, "old").unionByName(side(new, "new"), allowMissingColumns=True).write.partitionBy("side", "chunk_id").parquet(path)


def row_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    names = old.columns
    return old.exceptAll(new.select(*columns(names))).select(F.lit("old").alias("side"), "*").unionByName(new.select(*columns(names)).exceptAll(old).select(F.lit("new").alias("side"), "*"))
