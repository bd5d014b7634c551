"""Where two versions of a table differ, by checksums over key cuts that both sides share.

The cuts are every n-th key of the old side, so a row that only one side has changes one range and no other. A row's range follows from how many
rows of the old side have no larger key: both sides lie in key order together once, and one reading sums every range. Nothing is looked
up among the cuts and nothing is read again, however many ranges differ. Ranges are compared one by one, as checksums of what lies above
them would let equal changes of two ranges cancel; a tree over them (a node has `fanout` children) says how differences lie."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import columns, crc, quoted, xor_of
from tablewright.operators.chunks import key_ranges
from tablewright.sources.shared import computed

FANOUT = 32


@dataclass
class Level:
    """Of a descent: nodes whose children are looked at, children in which a leaf differs, rows of both sides below the nodes."""

    nodes: int
    differing: int
    rows: int


@dataclass
class ChecksumTree:
    """Ranges of a table's keys (leaves, numbered from 0, of `rows` rows each), and what differs between the table and another version of it."""

    keys: list[str]
    rows: int
    range_of: Column  # of the keys: ranges that tasks work on
    before: list[int]  # rows of the table in the ranges before each one
    fanout: int = FANOUT
    leaves: DataFrame | None = None

    @staticmethod
    def over(table: DataFrame, keys: list[str], rows: int, fanout: int = FANOUT) -> ChecksumTree:
        """Leaves of `rows` rows of the table."""
        range_of = key_ranges(table, keys, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sizes = dict(table.select(range_of.alias("__range")).groupBy("__range").count().collect())  # a few thousand at most
        before = list(itertools.accumulate((sizes.get(r, 0) for r in range(max(sizes, default=-1) + 1)), initial=0))
        return ChecksumTree(keys, rows, range_of, before, fanout)

    @property
    def depth(self) -> int:
        leaves, depth = max(1, -(-self.before[-1] // self.rows)), 1
        while self.fanout**depth < leaves:
            depth += 1
        return depth

    def summed(self, old: DataFrame, new: DataFrame, names: list[str], hashed: Callable[[str], Column] = crc) -> DataFrame:
        """node (a leaf), first (its first key in the old side, a struct), cnt_old, cnt_new, mismatched (names) of every leaf that has rows."""
        hashes = [f"__hash{i}" for i in range(len(names))]
        side = lambda frame, is_old: frame.select(*columns(self.keys), F.lit(is_old).alias("__old"), *[hashed(n).alias(h) for n, h in zip(names, hashes, strict=True)])
        both = side(old, True).union(side(new, False)).withColumn("__range", self.range_of)
        # rows of the old side with the same or a smaller key: the frame takes in all rows of an equal key
        upto = F.sum(F.col("__old").cast("long")).over(Window.partitionBy("__range").orderBy(*columns(self.keys)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        earlier = F.get(F.array(*[F.lit(n).cast("long") for n in self.before]), F.least(F.col("__range"), F.lit(len(self.before) - 1)))
        leaf = F.greatest(F.floor((upto + earlier - 1) / self.rows), F.lit(0)).cast("long")
        of = lambda is_old, column: F.when(F.col("__old") == is_old, column)
        sums = [xor_of(of(is_old, F.col(h))).alias(f"{h}_{is_old}") for h in hashes for is_old in (True, False)]
        counts = [F.count(of(is_old, F.lit(1))).alias(c) for c, is_old in (("cnt_old", True), ("cnt_new", False))]
        first = F.min(of(True, F.struct(*columns(self.keys)))).alias("first")
        parts = both.withColumn("node", leaf).groupBy("node").agg(first, *counts, *sums)
        alone = (F.col("cnt_old") == 0) | (F.col("cnt_new") == 0)
        odd = F.filter(F.array(*[F.when(alone | (F.col(f"{h}_True") != F.col(f"{h}_False")), F.lit(n)) for n, h in zip(names, hashes, strict=True)]), lambda c: c.isNotNull())
        return parts.select("node", "first", "cnt_old", "cnt_new", F.array_join(odd, ",").alias("mismatched"))

    def differing(self, old: DataFrame, new: DataFrame, names: list[str], hashed: Callable[[str], Column] = crc) -> DataFrame:
        """node (a leaf's number), cnt_old, cnt_new, mismatched of every leaf that differs. old: the table that the tree was made over."""
        self.leaves = computed(self.summed(old, new, names, hashed))
        return self.odd().drop("first")

    def odd(self) -> DataFrame:
        return self.leaves.where((F.col("cnt_old") != F.col("cnt_new")) | (F.col("mismatched") != ""))

    @functools.cached_property
    def levels(self) -> list[Level]:
        """The descent from the root down to the leaves that differ, after `differing`."""
        out, at = [], lambda width: F.floor(F.col("node") / width).cast("long").alias("above")
        for level in range(self.depth):
            wide, narrow = self.fanout ** (self.depth - level), self.fanout ** (self.depth - level - 1)
            asked = self.odd().select(at(wide)).distinct()
            below = self.leaves if level == 0 else self.leaves.withColumn("above", at(wide)).join(asked, "above", "left_semi")
            rows = below.agg(F.coalesce(F.sum(F.col("cnt_old") + F.col("cnt_new")), F.lit(0))).first()[0]
            out.append(Level(asked.count() if level else 1, self.odd().select(at(narrow)).distinct().count(), rows))
            if not out[-1].differing:
                break
        return out


def differing_chunks(old: DataFrame, new: DataFrame, keys: list[str], names: list[str], rows: int, fanout: int = FANOUT, hashed: Callable[[str], Column] = crc) -> DataFrame:
    """chunk_id, first_<key>..., cnt_old, cnt_new, mismatched of every chunk of `rows` rows of the old side (by keys) in which the sides differ. Keys of
    both sides order alike; rows before the first chunk's first key belong to it, and rows of the new side behind the last to the last."""
    tree = ChecksumTree.over(old, keys, rows, fanout)
    tree.differing(old, new, names, hashed)
    first = [F.when(F.col("node") > 0, F.col(f"first.{quoted(k)}")).alias(f"first_{k}") for k in keys]  # none of the first chunk, which has no cut
    return tree.odd().select(F.col("node").alias("chunk_id"), *first, "cnt_old", "cnt_new", "mismatched")
