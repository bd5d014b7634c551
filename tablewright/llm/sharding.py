"""Sharding by fixed virtual slots.

Records are hashed (id and text) into a fixed number of virtual slots, bytes and rows are
summed for each slot, and a versioned map says which shard holds a slot. Rebalancing edits the
last map: slots without a shard (all of them at first), of shards that are gone, or of shards that are
too full go to the lightest shards, largest first; all others stay. An edited map is a new version. The
law is `bytes`: shard sizes are nearly equal. The map has `virtual_slots` rows whatever the
input, so it is planned on the driver and broadcast.

Null texts count no bytes, null ids are hashed as such with the text. Equal rows (ties) share a
virtual slot and get places of their own. Texts of any length are one record. An empty table gives a
map and no rows. Extra columns, of whatever name, pass through, but columns named as the added ones
(size, text_crc32, virtual_slot, shard, slot) are replaced.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions.columns import quoted

VIRTUAL_SLOTS = 4096
ROW_BYTES = 8


ADDED = ["size", "text_crc32", "virtual_slot", "shard", "slot"]


def with_slots(docs: DataFrame, virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """row (all columns of docs), doc_id, size, text_crc32 and virtual_slot."""
    text = F.coalesce("text", F.lit(""))
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row")
    size = F.octet_length(text).cast("long") + F.lit(ROW_BYTES).cast("long")
    return docs.select(row, "doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(virtual_slots)).cast("int").alias("virtual_slot"))


def slot_sizes(slotted: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: as many rows as there are slots in use."""
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rebalance(placed: dict[int, int], sizes: dict[int, int], shards: int, virtual_slots: int = VIRTUAL_SLOTS, tolerance: float = 0.02) -> dict[int, int]:
    """slot -> shard: the map edited for `shards` shards. Slots leave shards that are no longer there or are over the
    mean by more than the tolerance, largest that fit first, for the lightest shards; new ones go there too."""
    kept = {slot: shard for slot, shard in placed.items() if shard < shards}
    moving = [slot for slot in range(virtual_slots) if slot not in kept]
    largest = lambda slots: sorted(slots, key=lambda s: (-sizes.get(s, 0), s))
    held: dict[int, list[int]] = {shard: [] for shard in range(shards)}
    for slot, shard in kept.items():
        held[shard].append(slot)
    load = {shard: sum(sizes.get(s, 0) for s in slots) for shard, slots in held.items()}
    mean = sum(sizes.values()) / shards
    for shard, slots in held.items():
        for slot in largest(slots):
            size = sizes.get(slot, 0)
            if size and load[shard] > mean * (1 + tolerance) and load[shard] - size >= mean * (1 - tolerance):
                moving.append(slot)
                load[shard] -= size
                held[shard] = [s for s in held[shard] if s != slot]
    heap = [(bytes_, len(held[shard]), shard) for shard, bytes_ in load.items()]
    heapq.heapify(heap)
    for slot in largest(moving):
        total, count, shard = heapq.heappop(heap)
        kept[slot] = shard
        heapq.heappush(heap, (total + sizes.get(slot, 0), count + 1, shard))
    return kept


def save_map(spark: SparkSession, placed: dict[int, int], shards: int, path: str, version: int) -> None:
    """Append a version of the map to the Parquet table at path."""
    rows = [(version, shards, slot, shard) for slot, shard in sorted(placed.items())]
    spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int").coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, int, dict[int, int]]:
    """Version, number of shards, and slot -> shard of a version, the last by default; version 0 is the empty map of a path
    where there is none yet."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, 0, {}
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).collect()  # as many as there are virtual slots
    return version, rows[0].shards, {r.virtual_slot: r.shard for r in rows}


def shard_documents(docs: DataFrame, shards: int, map_path: str, virtual_slots: int = VIRTUAL_SLOTS, tolerance: float = 0.02) -> DataFrame:
    """docs with size, text_crc32, virtual_slot, shard and slot, the row's place in its shard (from 0,
    without gaps). The last version of the map at map_path (if any) is rebalanced; what that changes is a new version."""
    spark = docs.sparkSession
    slotted = with_slots(docs, virtual_slots)
    found = slot_sizes(slotted).collect()  # at most virtual_slots rows
    rows = {r.virtual_slot: r.rows for r in found}
    version, shards_before, before = load_map(spark, map_path)
    if before and len(before) != virtual_slots:
        raise ValueError(f"the map at {map_path} has {len(before)} virtual slots, not {virtual_slots}")
    placed = rebalance(before, {r.virtual_slot: r.bytes for r in found}, shards, virtual_slots, tolerance)
    if placed != before or shards != shards_before:
        save_map(spark, placed, shards, map_path, version + 1)
    first, filled = [], dict.fromkeys(range(shards), 0)
    for slot, shard in sorted(placed.items()):
        first.append((slot, shard, filled[shard]))
        filled[shard] += rows.get(slot, 0)
    table = spark.createDataFrame(first, "virtual_slot int, shard int, first long")
    place_in = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    put = slotted.join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("first") + place_in - 1)
    return put.select(*[F.col(f"row.{quoted(c)}") for c in docs.columns if c not in ADDED], *ADDED)
