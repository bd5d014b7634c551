"""Column expressions: quoting, key ranges, checksums."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose text form is not stable enough for a checksum.
UNCHECKED = (T.FloatType, T.DoubleType, T.VariantType, T.ArrayType, T.MapType, T.StructType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns(names: list[str], table: str | None = None) -> list[Column]:
    return [F.col(f"{table}.{quoted(n)}" if table else quoted(n)) for n in names]


def after(keys: list[str], values: list[object]) -> Column:
    """Rows strictly after a key in lexicographic order, as an OR of comparisons that Parquet can use."""
    if len(keys) != len(values):
        raise ValueError("as many values as key columns are needed")
    terms = []
    for i, (key, value) in enumerate(zip(keys, values, strict=True)):
        same = [F.col(quoted(k)) == F.lit(v) for k, v in zip(keys[:i], values[:i], strict=True)]
        terms.append(functools.reduce(operator.and_, [*same, F.col(quoted(key)) > F.lit(value)]))
    return functools.reduce(operator.or_, terms, F.lit(False))


def matches(left: str, right: str, keys: list[str]) -> Column:
    """Plain equality of all keys: a null key matches nothing."""
    return functools.reduce(operator.and_, [F.col(f"{left}.{quoted(k)}") == F.col(f"{right}.{quoted(k)}") for k in keys])


def checked_columns(frame: DataFrame, leave_out: list[str] = ()) -> list[str]:
    """Columns that checksums may read: no floating, nested or variant ones."""
    return [f.name for f in frame.schema if not isinstance(f.dataType, UNCHECKED) and f.name not in leave_out]


def crc(name: str) -> Column:
    return F.crc32(F.col(quoted(name)).cast("string").cast("binary"))


def md5_prefix(name: str) -> Column:
    """60 bits of MD5 as a long: the portable hash, which other engines can compute."""
    return F.conv(F.substring(F.md5(F.col(quoted(name)).cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def xor_of(hashed: Column) -> Column:
    """Order-independent checksum; 0 where there is nothing."""
    return F.coalesce(F.bit_xor(hashed), F.lit(0).cast("long"))


def collated(frame: DataFrame, collations: dict[str, str]) -> DataFrame:
    """The frame with text columns that compare by a collation (as UTF8_LCASE: case does not matter), in joins, orders, groups and key ranges alike."""
    return frame.select(*[F.collate(c, collations[n]).alias(n) if n in collations else c for n, c in zip(frame.columns, columns(frame.columns), strict=True)])


def readable_size(count: int) -> str:
    size = float(count)
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            return f"{size:.2f} {unit}"
        size /= 1024
    raise AssertionError


def days(date: Column) -> Column:
    """Days since year 0, as partition bounds use them."""
    return F.unix_date(date) + 719528
