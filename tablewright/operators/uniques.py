"""Rows under several unique keys at once, taken one by one: a row is refused if it shares a key with a row that was taken before
it; a refused row blocks nothing.

That is decided in rounds. A row that is the first of all undecided rows in each of its keys is taken, and rows that share a
key with it are refused. Each round is stored. Once few rows are undecided one task takes them in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import columns, quoted
from tablewright.sources.shared import computed

FEW = 100_000  # undecided (row, key) pairs that one task may hold


def key_text(names: list[str]) -> Column:
    """A text that only equal keys share; null if a column of the key is null, as null keys share nothing."""
    each = [F.hex(F.col(quoted(n)).cast("string").cast("binary")) for n in names]
    return F.concat(*[x for e in each for x in (e, F.lit(","))])


def in_order(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places of refused rows, from all (place, keys) in order."""
    taken: set[str] = set()
    refused = []
    for place, keys in (row for piece in pieces for row in zip(piece["place"], piece["held"], strict=True)):
        if taken.isdisjoint(keys):
            taken.update(keys)
        else:
            refused.append(place)
    yield pd.DataFrame({"place": pd.array(refused, "int64")})


def refused_places(keyed: DataFrame, few: int = FEW) -> DataFrame:
    """place of rows that are refused; keyed: place (unique), key (once for each key of a row that is not null)."""
    left, out = computed(keyed), []
    while True:
        first = left.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        left = left.join(first.where("n > 1"), "key", "left").select("place", "key", "first")
        judged = left.groupBy("place").agg(F.bool_and(F.coalesce(F.col("first") == F.col("place"), F.lit(True))).alias("leads"), F.bool_or(F.col("first").isNotNull()).alias("meets"))
        open_ = computed(left.join(judged.where("meets"), "place"))  # rows that meet no other are taken
        if not open_.limit(1).count():
            break
        held = open_.where("leads").select("key").distinct()
        gone = computed(open_.where("NOT leads").join(held, "key", "left_semi").select("place").distinct())
        out.append(gone)
        left = computed(open_.where("NOT leads").join(gone, "place", "left_anti").select("place", "key"))
        if left.limit(few + 1).count() <= few:  # a bounded rest
            rest = left.groupBy("place").agg(F.collect_list("key").alias("held")).coalesce(1).sortWithinPartitions("place")
            out.append(computed(rest.mapInPandas(in_order, "place long")))
            break
    empty = keyed.select("place").limit(0)
    for part in out:
        empty = empty.unionByName(part)
    return empty


def accepted(rows: DataFrame, unique: list[list[str]], order: list[str], table: DataFrame | None = None, few: int = FEW) -> DataFrame:
    """The rows that are taken, in the order of `order` (rows equal in that: by all columns), into a table whose rows came before all."""
    plain = rows.columns
    for names in unique if table is not None else []:
        there = table.select(key_text(names).alias("__key")).where("__key IS NOT NULL").distinct()
        rows = rows.withColumn("__key", key_text(names)).join(there, "__key", "left_anti").select(*columns(plain))
    placed = computed(placed_in_order(rows, order))
    keys = F.array(*[F.concat(F.lit(f"{i}:"), key_text(names)) for i, names in enumerate(unique)])
    keyed = placed.select("place", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))
    return placed.join(refused_places(keyed, few), "place", "left_anti").select(*columns(plain))


def placed_in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, their number in the order."""
    from tablewright.operators.chunks import numbered

    tie = F.xxhash64(*columns(rows.columns))
    return numbered(rows.withColumn("__tie", tie), [*order, "__tie"], "place").withColumn("place", F.col("place").cast("long")).drop("__tie")
