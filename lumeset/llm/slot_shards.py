"""Sharding through fixed virtual slots.

A record's key is hashed into one of thousands of slots, and that never changes. Bytes are summed per
slot, and a slot-to-shard map, stored by version, says where each slot lives. Rebalancing edits the map:
it moves whole slots from the heaviest shard to the lightest and writes the next version; growing moves
slots into the new shard only. The map has a fixed number of rows whatever the data, so it alone is
handled on the driver and broadcast.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from lumeset.llm.common import materialise

SLOTS = 8192
SHARDS = 40
ROW_OVERHEAD = 16  # bytes that a record takes besides its text
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, before long"


def to_slots(df: DataFrame, *key: str, slots: int = SLOTS) -> DataFrame:
    """Add ``virtual_slot``; equal keys go to the same slot, null ones too."""
    return df.withColumn("virtual_slot", F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int"))


def split_slots(df: DataFrame, sizes: np.ndarray, rows: np.ndarray, shards: int, slots: int) -> tuple[DataFrame, int]:
    """Deal the rows of slots that hold more than an eighth of a shard's share to further slots by ``row``, and the number of slots then.

    Such a slot holds one record repeated many times, or a very large one. There are at most 16 further slots a shard.
    """
    limit = max(1, int(sizes.sum()) // (8 * shards))
    split, at = [], slots
    for s in np.flatnonzero((sizes > limit) & (rows > 1)).tolist():
        parts = min(int(rows[s]), -(-int(sizes[s]) // limit))
        split += [(s, at, parts)]
        at += parts
    if not split:
        return df, slots
    first, parts = (F.create_map(*(F.lit(x) for row in split for x in (row[0], row[k]))) for k in (1, 2))
    further = (first[F.col("virtual_slot")] + F.pmod("row", parts[F.col("virtual_slot")].cast("long"))).cast("int")
    return df.withColumn("virtual_slot", F.coalesce(further, "virtual_slot")), at


def slot_totals(df: DataFrame, size: str = "size", slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot (df has virtual_slot); at most ``slots`` rows come to the driver."""
    sizes, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in df.groupBy("virtual_slot").agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]], rows[r["virtual_slot"]] = r["b"] or 0, r["n"]
    return sizes, rows


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """Version 1: slots in equal contiguous runs."""
    return (np.arange(slots, dtype=np.int64) * shards // slots).astype(np.int32)


def rebalance(shard_of: np.ndarray, sizes: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """Edit a map until no move of one slot from the heaviest shard lowers its excess over the lightest."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=sizes, minlength=shards).astype(np.int64)
    while True:
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        own = np.flatnonzero((shard_of == high) & (sizes > 0) & (sizes < gap))
        if not len(own):
            return shard_of
        move = own[np.abs(2 * sizes[own] - gap).argmin()]
        shard_of[move] = low
        load[high] -= sizes[move]
        load[low] += sizes[move]


def grow(shard_of: np.ndarray, sizes: np.ndarray, shards: int) -> np.ndarray:
    """A map for shards + 1: slots move into the new shard only, each from the shard that is then heaviest."""
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=sizes, minlength=shards + 1).astype(np.int64)
    goal = int(load.sum()) // (shards + 1)
    while True:
        high = int(load[:shards].argmax())
        own = np.flatnonzero((shard_of == high) & (sizes > 0) & (sizes <= goal - load[shards]))
        if not len(own):
            return shard_of
        move = own[sizes[own].argmax()]
        shard_of[move] = shards
        load[high] -= sizes[move]
        load[shards] += sizes[move]


def map_rows(version: int, shard_of: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> list[tuple]:
    """Rows of MAP_SCHEMA; ``before`` is the number of records in lower slots of the same shard."""
    before = np.zeros(len(rows), np.int64)
    for shard in np.unique(shard_of):
        own = np.flatnonzero(shard_of == shard)
        before[own] = np.cumsum(rows[own]) - rows[own]
    return [(version, s, int(shard_of[s]), int(sizes[s]), int(rows[s]), int(before[s])) for s in range(len(rows))]


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """Deal records to shards whose bytes are nearly equal.

    docs: doc_id, text; other columns are ignored. Null and empty texts take the row overhead only. A record's slot follows from its id, size and
    checksum; slots that hold much more than others (a record that repeats) are split. Shards can differ by a slot at most, so a
    record larger than an equal share still fills a shard of its own. Returns (records, map): the records with size,
    text_crc32, virtual_slot, shard and place (gapless from 0 in each shard); the map with both its versions.
    """
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    sized = to_slots(sized, "doc_id", "size", "text_crc32", slots=slots).withColumn("row", F.monotonically_increasing_id())
    sized = materialise(sized, "sized")  # so that row numbers stay
    sizes, rows = slot_totals(sized, slots=slots)
    sized, all_slots = split_slots(sized, sizes, rows, shards, slots)
    if all_slots > slots:
        slots = all_slots
        sizes, rows = slot_totals(sized, slots=slots)
    first = first_map(slots, shards)
    edited = rebalance(first, sizes, shards)
    table = materialise(spark.createDataFrame(map_rows(1, first, sizes, rows) + map_rows(2, edited, sizes, rows), MAP_SCHEMA), "slot_map")
    current = table.where("version = 2").select(F.col("slot").alias("virtual_slot"), "shard", "before")
    placed = sized.join(F.broadcast(current), "virtual_slot")  # as many rows as slots, at most a constant and 16 a shard
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("place", F.col("before") + rank - 1).drop("before", "row"), table


def op1_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law ``bytes``; ``slot`` is the place in the shard, ``virtual_slot`` the slot of the map."""
    records, _ = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return records.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
