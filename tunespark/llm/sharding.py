"""Sharding by fixed virtual slots.

A record's hash puts it into one of thousands of virtual slots for good. Bytes and rows are summed by slot, and a map from slots to shards,
kept under version numbers, says where slots lie. Rebalancing edits the map: it moves or swaps slots between the heaviest and the lightest
shard until they are near equal, and records follow their slots. The map has as many rows as there are slots, whatever the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunespark.llm.common import materialize

SLOTS, SHARDS, RECORD_BYTES = 8192, 24, 8
MOST_EDITS = 200_000


@dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot, under a version."""

    version: int
    shard: np.ndarray
    shards: int

    @classmethod
    def fresh(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        return cls(1, np.arange(slots) % shards, shards)

    def rebalanced(self, size: np.ndarray, tolerance: float = 1e-4) -> SlotMap:
        """The next version: slots moved or swapped so that the shards' sizes are near equal."""
        shard, load = self.shard.copy(), np.bincount(self.shard, size, self.shards)
        for _ in range(MOST_EDITS):
            high, low = int(load.argmax()), int(load.argmin())
            gap = load[high] - load[low]
            if gap <= tolerance * load.mean():
                break
            ours, theirs = np.flatnonzero(shard == high), np.flatnonzero(shard == low)
            own, other = size[ours], np.append(size[theirs], 0)
            # what a swap (or a move, against 0) takes over should be half of the gap
            order = np.argsort(other, kind="stable")
            at = np.clip(np.searchsorted(other[order], own - gap / 2), 0, len(other) - 1)
            best = None
            for near in (at, np.maximum(at - 1, 0)):
                taken = own - other[order[near]]
                miss = np.abs(taken - gap / 2)
                i = int(miss.argmin())
                if best is None or miss[i] < best[0]:
                    best = (miss[i], i, int(order[near[i]]), taken[i])
            _, i, j, taken = best
            if not 0 < taken < gap:
                break
            shard[ours[i]] = low
            if j < len(theirs):
                shard[theirs[j]] = high
            load[high] -= taken
            load[low] += taken
        return SlotMap(self.version + 1, shard, self.shards)

    def grown(self, size: np.ndarray) -> SlotMap:
        """The next version with one more shard: slots move only into the new one, from the heaviest shards."""
        shard, load = self.shard.copy(), np.append(np.bincount(self.shard, size, self.shards), 0.0)
        goal = load.sum() / (self.shards + 1)
        for slot in np.argsort(-size, kind="stable"):
            from_ = shard[slot]
            if load[-1] + size[slot] <= goal and load[from_] - size[slot] >= goal - size.max():
                load[from_] -= size[slot]
                load[-1] += size[slot]
                shard[slot] = self.shards
        return SlotMap(self.version + 1, shard, self.shards + 1)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.version, i, int(s), self.shards) for i, s in enumerate(self.shard)]
        spark.createDataFrame(rows, "version int, virtual_slot int, shard int, shards int").coalesce(1).write.partitionBy("version").mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The map of a version, the latest unless one is named."""
        stored = spark.read.parquet(path)
        version = version or stored.agg(F.max("version")).first()[0]
        rows = stored.where(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(version, np.array([r["shard"] for r in rows]), rows[0]["shards"])


def slotted(docs: DataFrame, slots: int = SLOTS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row: the slot is a hash of the id and the text's checksum."""
    own = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sized = own.select("doc_id", (F.octet_length("text") + RECORD_BYTES).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, current: SlotMap | None = None, text: str = "text") -> tuple[DataFrame, SlotMap]:
    """(doc_id, size, text_crc32, virtual_slot, shard, slot) and the map: the current one rebalanced on the rows' bytes.

    slot is a record's place in its shard, without gaps from 0. Null texts count no bytes but RECORD_BYTES; repeated rows share a
    virtual slot and take a place each; other columns are ignored.
    """
    rows = materialize(slotted(docs, slots, text), "slotted")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    size, count = np.zeros(slots), np.zeros(slots, np.int64)
    for r in sums:
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["bytes"], r["rows"]
    made = (current or SlotMap.fresh(shards, slots)).rebalanced(size)
    base, filled = np.zeros(slots, np.int64), np.zeros(made.shards, np.int64)
    for i, s in enumerate(made.shard):
        base[i] = filled[s]
        filled[s] += count[i]
    table = rows.sparkSession.createDataFrame([(i, int(made.shard[i]), int(base[i])) for i in range(slots)], "virtual_slot int, shard int, base bigint")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")) - 1
    out = rows.withColumn("place", place).join(F.broadcast(table), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("place")).alias("slot")), made
