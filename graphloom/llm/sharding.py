"""Sharding by fixed virtual slots, with DataFrame functions only.

Records hash into a fixed number of slots (thousands). Bytes per slot are
aggregated, and a versioned slot-to-shard map says where each slot lives. Its
first version deals the slots out evenly. A
rebalance edits the map: it moves slots, never single records, and yields the
next version. The map has one entry a slot, so its size is fixed by a
parameter and it travels inside the plan as a constant.

Law held: ``bytes`` — shards differ by at most about one slot's bytes.
Records hash by doc_id, so a text that a third of all rows share spreads over
all slots.

Defined cases: a null text counts 16 bytes and has crc32 0; a null doc_id
hashes as an empty string; repeated rows are rows like others; an empty table
gives an empty result; extra columns are ignored by :func:`assign_shards` and
those called like its own outputs are dropped.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_root

SLOTS = 4096
SHARDS = 40
OVERHEAD = 16


@dataclass(frozen=True)
class SlotMap:
    """Version, shards, and for each slot its shard, rows and bytes when mapped."""

    version: int
    shards: int
    owner: tuple[int, ...]
    rows: tuple[int, ...] = field(default=(), repr=False)
    size: tuple[int, ...] = field(default=(), repr=False)

    @classmethod
    def even(cls, slots: int, shards: int) -> SlotMap:
        """Version 1, before any bytes are known: as many slots in each shard."""
        return cls(1, shards, tuple(k % shards for k in range(slots)), (0,) * slots, (0,) * slots)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += self.size[slot]
        return out

    def rebalanced(self, size: list[int], rows: list[int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """The next version for new byte counts or a new number of shards.

        Moves slots from the fullest to the emptiest shard while that narrows
        the gap, then exchanges one for a smaller one while that does; shards
        that are no more give up all their slots.
        """
        shards = shards or self.shards
        held: list[list[int]] = [[] for _ in range(shards)]
        homeless = []
        for slot, shard in enumerate(self.owner):
            (held[shard] if shard < shards else homeless).append(slot)
        load = [sum(size[k] for k in h) for h in held]
        for slot in sorted(homeless, key=lambda k: (-size[k], k)):
            to = min(range(shards), key=lambda s: (load[s], s))
            held[to].append(slot)
            load[to] += size[slot]
        mean = sum(load) / shards
        while True:
            low = min(range(shards), key=lambda s: (load[s], s))
            full = max(range(shards), key=lambda s: (load[s], -s))
            if load[full] - load[low] <= tolerance * mean:
                break
            # The fullest shard with a slot to give; one huge slot alone cannot move.
            back = None
            for top in sorted(range(shards), key=lambda s: (-load[s], s)):
                gap = load[top] - load[low]
                if fits := [k for k in held[top] if 0 < size[k] < gap]:
                    slot = min(fits, key=lambda k: (abs(size[k] - gap / 2), k))
                    break
            else:
                top, pair = full, _exchange(held[full], held[low], size, load[full] - load[low])
                if pair is None:
                    break
                slot, back = pair
                held[low].remove(back)
                held[top].append(back)
            held[top].remove(slot)
            held[low].append(slot)
            moved = size[slot] - (0 if back is None else size[back])
            load[top] -= moved
            load[low] += moved
        owner = [0] * len(self.owner)
        for shard, slots in enumerate(held):
            for slot in slots:
                owner[slot] = shard
        return replace(self, version=self.version + 1, shards=shards, owner=tuple(owner), rows=tuple(rows), size=tuple(size))

    def first_positions(self) -> list[int]:
        """For each slot, the rows of smaller slots in the same shard."""
        seen, out = [0] * self.shards, []
        for slot, shard in enumerate(self.owner):
            out.append(seen[shard])
            seen[shard] += self.rows[slot]
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the Parquet table at ``path``; older versions stay."""
        row = f"select {self.version} version, {self.shards} shards, '{json.dumps([self.owner, self.rows, self.size])}' slots"
        spark.sql(row).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        rows = spark.read.parquet(path)
        rows = rows.where(F.col("version") == version) if version else rows.orderBy(F.desc("version"))
        got = rows.first()
        return cls(got["version"], got["shards"], *(tuple(x) for x in json.loads(got["slots"])))


def _exchange(high: list[int], low: list[int], size: list[int], gap: int) -> tuple[int, int] | None:
    """A slot of each side whose exchange narrows the gap most, None if none does."""
    ordered = sorted(low, key=lambda k: (size[k], k))
    sizes, best = [size[k] for k in ordered], None
    for k in sorted(high):
        at = bisect_left(sizes, size[k] - gap / 2)
        for j in (at - 1, at):
            if 0 <= j < len(sizes) and 0 < size[k] - sizes[j] < gap:
                off = abs(size[k] - sizes[j] - gap / 2)
                if best is None or off < best[0]:
                    best = (off, k, ordered[j])
    return best and best[1:]


def _constant(values) -> F.Column:
    return F.from_json(F.lit(json.dumps(list(values))), "array<bigint>")


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every row."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; at most ``slots`` rows come to the driver."""
    size, n = [0] * slots, [0] * slots
    for slot, b, k in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        size[slot], n[slot] = b, k
    return size, n


def place(rows: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds shard and slot, the row's place in its shard (gapless from 0).

    Rows are numbered within a virtual slot, and each slot starts where the
    one before it in its shard ends: no window ever spans a shard.
    """
    at = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    k = F.col("virtual_slot")
    return rows.withColumn("shard", F.get(_constant(slot_map.owner), k).cast("int")).withColumn("slot", F.get(_constant(slot_map.first_positions()), k) + F.row_number().over(at) - 1)


def assign_shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    Texts are read once: the narrow rows are kept as a scratch table for the
    count and for the placement. The newest map at ``map_path`` is rebalanced by
    the bytes counted and stored there as the next version; where there is none
    yet, an even one is stored first. Without a path the scratch folder holds it.
    """
    spark = docs.sparkSession
    rows = materialise(slotted(docs, slots), "slotted")
    map_path = map_path or f"{scratch_root(spark)}/slot-map-{uuid.uuid4().hex[:12]}"
    try:
        slot_map = SlotMap.load(spark, map_path)
    except AnalysisException:  # no map yet
        SlotMap.even(slots, shards).save(spark, map_path)
        slot_map = SlotMap.load(spark, map_path)
    size, n = slot_loads(rows, slots)
    slot_map = slot_map.rebalanced(size, n, shards, tolerance=0)
    slot_map.save(spark, map_path)
    return place(rows, slot_map).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version"))
