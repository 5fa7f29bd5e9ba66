"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records hash into thousands of slots, once and for all. A map assigns slots to shards; it is
edited, not rebuilt, when shards must be balanced or added, and every version is stored. Only
DataFrame functions run on the executors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import constant, materialize, new_path

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shards[s]`` is the shard of slot ``s``."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @classmethod
    def initial(cls, n_shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(0, n_shards, tuple(s % n_shards for s in range(slots)))

    def rebalanced(self, weights: list[int], n_shards: int | None = None) -> SlotMap:
        """The next version: slots move until shard weights are as near to equal as slots allow.

        A shard gives slots only while it is over its fair share. Slots that were taken are
        dealt, heaviest first, to the lightest shard; then single moves and swaps with the
        lightest shard go on while they narrow the gap.
        """
        n = n_shards or self.n_shards
        held: list[list[int]] = [[] for _ in range(max(n, self.n_shards))]
        for slot, shard in enumerate(self.shards):
            held[shard].append(slot)
        total = [sum(weights[s] for s in own) for own in held]
        fair = sum(total) / n
        loose: list[int] = []
        for shard, own in enumerate(held):
            own.sort(key=lambda s: (weights[s], s))
            while own and (shard >= n or total[shard] > fair):
                slot = own.pop()
                total[shard] -= weights[slot]
                loose.append(slot)
        heap = [(total[k], k) for k in range(n)]
        heapq.heapify(heap)
        for slot in sorted(loose, key=lambda s: (-weights[s], s)):
            weight, shard = heapq.heappop(heap)
            held[shard].append(slot)
            total[shard] = weight + weights[slot]
            heapq.heappush(heap, (total[shard], shard))
        held, total = held[:n], total[:n]
        for _ in range(64 * n):
            top, low = max(range(n), key=total.__getitem__), min(range(n), key=total.__getitem__)
            gap = total[top] - total[low]
            moves = [(abs(gap - 2 * weights[a]), a, None) for a in held[top] if 0 < weights[a] < gap]
            light = sorted(held[low], key=lambda s: weights[s])[:64]
            moves += [(abs(gap - 2 * (weights[a] - weights[b])), a, b) for a in held[top] for b in light if 0 < weights[a] - weights[b] < gap]
            if not moves:
                break
            _, a, b = min(moves, key=lambda m: (m[0], m[1], m[2] or 0))
            held[top].remove(a)
            held[low].append(a)
            total[top], total[low] = total[top] - weights[a], total[low] + weights[a]
            if b is not None:
                held[low].remove(b)
                held[top].append(b)
                total[top], total[low] = total[top] + weights[b], total[low] - weights[b]
        shards = [0] * len(self.shards)
        for shard, own in enumerate(held):
            for slot in own:
                shards[slot] = shard
        return SlotMap(self.version + 1, n, tuple(shards))

    def store(self, spark: SparkSession, folder: str) -> str:
        """Write this version as ``<folder>/version=<n>``; earlier versions stay."""
        rows = [(slot, shard, self.n_shards) for slot, shard in enumerate(self.shards)]
        path = f"{folder}/version={self.version}"
        spark.createDataFrame(rows, "slot int, shard int, n_shards int").coalesce(1).write.mode("overwrite").parquet(path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = sorted((r.slot, r.shard, r.n_shards) for r in spark.read.parquet(f"{folder}/version={version}").collect())
        return cls(version, rows[0][2], tuple(r[1] for r in rows))

    def shard_of(self, slot: Column) -> Column:
        return F.element_at(constant(self.shards, "int"), slot + 1)


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record: depends on its keys and the fixed number of slots only."""
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def shard_records(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, current: SlotMap | None = None, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Put every row into a shard, sizes near equal; the rows and the map that placed them.

    A row's size is the UTF-8 bytes of its text plus one. Rows hash by id and text checksum. So equal
    texts with different ids are dealt over the slots, and a group of copies that holds a third of all
    bytes is spread as evenly as any rows; rows that repeat both id and text share a slot, which is the
    unit of placement, so the law of near-equal bytes holds as far as no such group exceeds a shard's
    fair share. Bytes are summed per slot (a table of ``slots`` rows at most, which the driver reads) and
    the ``current`` map, else the initial one, is rebalanced into its next version and stored in
    ``folder``, else in the shared folder.

    Columns: id, size, text_crc32, virtual_slot, shard, position (gapless from 0 in each shard).
    Null ids and texts hash like any other value; null text has size 1 and checksum 0. Very long texts
    are measured where they lie and never move. An empty table gives no rows. Other columns of ``df``
    are never read, so their names can't clash.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    rows = materialize(rows.withColumn("virtual_slot", slot_of(F.col("id"), F.col("crc"), slots=slots)), "sized")
    found = rows.groupBy("virtual_slot").agg(F.sum("size"), F.count(F.lit(1))).collect()  # a row per slot at most
    weights, counts = [0] * slots, [0] * slots
    for slot, size, n in found:
        weights[slot], counts[slot] = size, n
    placed = (current or SlotMap.initial(n_shards, slots)).rebalanced(weights, n_shards)
    placed.store(spark, folder or new_path(spark, "slot_map"))
    before, filled = [0] * slots, [0] * n_shards
    for slot, shard in enumerate(placed.shards):
        before[slot] = filled[shard]
        filled[shard] += counts[slot]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "crc")) - 1
    slot = F.col("virtual_slot")
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "virtual_slot",
        placed.shard_of(slot).alias("shard"),
        (F.element_at(constant(before, "bigint"), slot + 1) + rank).alias("position"),
    ), placed
