"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots (4096). Bytes and rows are aggregated per slot, and a slot-to-shard map,
stored as versions of edits, says where each slot lives. Rebalancing edits the map: a slot moves or two slots change
places until no such step brings the heaviest and the lightest shard closer. Records never need to be hashed again.

Only one row per slot reaches the driver, so that side is bounded by the number of slots and not by the data.

Defined cases: a null text has size 1; a null ``doc_id`` hashes like a value; repeated rows share a slot and get
different places; equal texts under different ids are records of their own and may lie in different shards, as the law balances bytes
alone; a very long text weighs what it has and is never cut; an empty table gives no rows; columns besides ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, stored, unsigned_crc

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size in bytes plus one, checksum of the text and the virtual slot."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return (docs.select("doc_id", size.alias("size"), unsigned_crc(F.col("text")).alias("text_crc32"))
            .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slots)).cast("int")))


def slot_loads(recs: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot."""
    load, rows = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in recs.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        load[r.virtual_slot], rows[r.virtual_slot] = r.b, r.n
    return load, rows


def first_map(shards: int, slots: int = SLOTS) -> np.ndarray:
    """Version 0: equal runs of slots."""
    return (np.arange(slots) * shards // slots).astype(np.int32)


def rebalance(slot_map: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map after moves and exchanges between the heaviest shard and a lighter one, while they shrink the gap."""
    now = slot_map.copy()
    total = np.bincount(now, weights=load, minlength=shards).astype(np.int64)
    for _ in range(8 * len(now)):
        done = True
        top = int(total.argmax())
        heavy = np.flatnonzero((now == top) & (load > 0))
        for low in np.argsort(total, kind="stable")[:shards - 1]:
            gap = total[top] - total[low]
            if low == top or gap < 2 or not len(heavy):
                continue
            light = np.concatenate([[-1], np.flatnonzero((now == low) & (load > 0))])
            light = light[np.argsort(np.where(light < 0, 0, load[light]), kind="stable")]
            give, take = load[heavy], np.where(light < 0, 0, load[light])
            at = np.clip(np.searchsorted(take, give - gap // 2), 0, len(take) - 1)
            best, pair = gap, None
            for shift in (0, -1):
                k = np.clip(at + shift, 0, len(take) - 1)
                left = np.abs(gap - 2 * (give - take[k]))
                i = int(left.argmin())
                if left[i] < best:
                    best, pair = int(left[i]), (int(heavy[i]), int(light[k[i]]))
            if pair is None:
                continue
            a, b = pair
            now[a] = low
            moved = load[a] - (load[b] if b >= 0 else 0)
            if b >= 0:
                now[b] = top
            total[top] -= moved
            total[low] += moved
            done = False
            break
        if done:
            break
    return now


def grow(slot_map: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """The map with one shard more: slots leave the heaviest shards for the new one only, up to its equal share."""
    now, total = slot_map.copy(), np.bincount(slot_map, weights=load, minlength=shards + 1).astype(np.int64)
    share = int(load.sum()) // (shards + 1)
    while total[shards] < share:
        top = int(total[:shards].argmax())
        own = np.flatnonzero((now == top) & (load > 0) & (load <= share - total[shards]))
        if not len(own):
            break
        a = int(own[np.abs(load[own] - (total[top] - share)).argmin()])
        now[a] = shards
        total[top] -= load[a]
        total[shards] += load[a]
    return now


def store_map(spark: SparkSession, folder: str, version: int, slot_map: np.ndarray, before: np.ndarray | None = None) -> None:
    """Writes a version: the whole map at first, later only the slots that changed."""
    changed = np.arange(len(slot_map)) if before is None else np.flatnonzero(slot_map != before)
    rows = [(int(s), int(slot_map[s])) for s in changed]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """The map as of a version: for each slot its last edit up to then."""
    edits = None
    for v in range(version + 1):
        part = spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={v}").withColumn("version", F.lit(v))
        edits = part if edits is None else edits.unionByName(part)
    return edits.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("edited"))


def assign(recs: DataFrame, slot_map: DataFrame, rows: np.ndarray) -> DataFrame:
    """Every record with its shard and its place there, gapless from 0: the rows of the shard's earlier slots come first.

    The rank is taken within a slot, so no task ever orders a whole shard."""
    spark = recs.sparkSession
    counts = spark.createDataFrame([(s, int(n)) for s, n in enumerate(rows)], "virtual_slot int, n long")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.join(counts, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (recs.withColumn("rank", rank.cast("long") - 1).join(F.broadcast(places), "virtual_slot")
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("first") + F.col("rank")).alias("slot")))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """All documents in shards of nearly equal bytes, through version 1 of a stored map."""
    spark = docs.sparkSession
    recs = stored(records(docs, slots))
    load, rows = slot_loads(recs, slots)
    folder, start = shared_folder(spark), first_map(shards, slots)
    store_map(spark, folder, 0, start)
    store_map(spark, folder, 1, rebalance(start, load, shards), start)
    return assign(recs, load_map(spark, folder, 1), rows)
