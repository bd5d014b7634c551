"""Blocks of queries beside blocks of rows: the way to hold a stated set of queries against all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm._shared import BROADCAST_BYTES


def block_pairs(rows: DataFrame, queries: DataFrame, blocks: int, size: Column) -> DataFrame:
    """Every block of rows (row_block, ...) with every block of queries (query_block of 0 to blocks - 1, ...), packed in one row
    each. The queries are broadcast only where the bytes of all (size: of one block) are few; else both sides are dealt by
    block of queries and a share of the rows, so that no task holds all of either."""
    dealt = rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if (queries.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return dealt.join(F.broadcast(queries), "query_block")
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("row_block"), F.lit(shares)).cast("int")
    everywhere = queries.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return dealt.withColumn("share", share).join(everywhere, ["query_block", "share"]).drop("share")
