"""Key-ordered chunks without a global sort in one task: rows are cut into ranges of the whole key,
numbered within each range, and shifted by the rows of the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tablewright.functions.columns import columns, quoted

LEAST_ROW_BYTES = 20
SAMPLE, MOST_RANGES = 20, 4096


def rows_per_chunk(chunk_bytes: int, row_bytes: int) -> int:
    """Rows of a chunk: at least one, and odd, so that pairs of equal rows do not cancel in a whole chunk."""
    rows = max(1, chunk_bytes // max(row_bytes, LEAST_ROW_BYTES))
    return rows + 1 - rows % 2


def key_ranges(frame: DataFrame, keys: list[str], ranges: int) -> Column:
    """Number of the row's range of keys, of any type. The cuts come from SAMPLE random rows a range, which decide
    only how even the ranges are; at most MOST_RANGES cuts, among which a row finds its place by halving. Equal keys share a range."""
    ranges = min(ranges, MOST_RANGES)
    drawn = frame.select(*columns(keys), F.rand().alias("__r")).orderBy("__r").limit(SAMPLE * ranges).select(*columns(keys))
    rows = drawn.orderBy(*columns(keys)).collect() if ranges > 1 else []
    picked = [r for i, r in enumerate(rows[SAMPLE::SAMPLE]) if i == 0 or r != rows[i * SAMPLE]]
    alone = len(keys) == 1  # then values are compared, not structs, in which nulls come first: a null is below no cut's value and cuts nothing
    picked = [r for r in picked if not alone or r[0] is not None]
    if not picked:
        return F.lit(0)
    value = lambda k, v: F.lit(v).cast(frame.schema[k].dataType).alias(k)
    cuts = F.array(*[value(keys[0], r[0]) if alone else F.struct(*[value(k, v) for k, v in zip(keys, r, strict=True)]) for r in picked])
    key = F.col(quoted(keys[0])) if alone else F.struct(*[c.alias(k) for c, k in zip(columns(keys), keys, strict=True)])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(picked).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda below, step: F.when(F.get(cuts, below + step - 1) < key, below + step).otherwise(below))


def numbered(frame: DataFrame, keys: list[str], name: str = "row_no") -> DataFrame:
    """frame with the rows' numbers in key order, from 1."""
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = frame.withColumn("__range", key_ranges(frame, keys, ranges))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))  # at most `ranges` rows
    first = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*columns(keys)))
    return ranged.join(F.broadcast(first), "__range").withColumn(name, within + F.col("__first")).drop("__range", "__first")


def chunked(frame: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """frame with chunk_id, from 0, of `rows` rows each in key order."""
    return numbered(frame, keys, "__row").withColumn("chunk_id", F.floor((F.col("__row") - 1) / rows).cast("long")).drop("__row")


def chunk_counts(frame: DataFrame, keys: list[str], rows: int) -> DataFrame:
    return chunked(frame, keys, rows).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("cnt"))


def boundaries(frame: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """chunk_id with the first and last key of each chunk."""
    key = F.struct(*columns(keys))
    ends = chunked(frame, keys, rows).groupBy("chunk_id").agg(F.min(key).alias("a"), F.max(key).alias("b"))
    return ends.select("chunk_id", *[F.col(f"a.{quoted(k)}").alias(f"first_{k}") for k in keys], *[F.col(f"b.{quoted(k)}").alias(f"last_{k}") for k in keys])


def next_page(frame: DataFrame, keys: list[str], start: Column | None, rows: int) -> DataFrame:
    """The first `rows` rows after a key, in key order: a bounded page, by TakeOrderedAndProject."""
    return (frame if start is None else frame.where(start)).orderBy(*columns(keys)).limit(rows)


def dump(frame: DataFrame, keys: list[str] | None, rows: int, path: str) -> None:
    """Write the table for `load`: chunks of `rows` rows, one folder each, sorted by key; or, without a key to cut by, as it lies."""
    if not keys:
        frame.write.parquet(path)
        return
    chunks = chunked(frame, keys, rows)
    chunks.repartition("chunk_id").sortWithinPartitions("chunk_id", *columns(keys)).write.partitionBy("chunk_id").parquet(path)


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What `dump` wrote, in all its chunks, without the chunks' numbers."""
    return spark.read.schema(schema).parquet(path).select(*columns(schema.names))
