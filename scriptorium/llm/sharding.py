"""Fixed virtual slots: balanced shards through a versioned slot-to-shard map.

A record belongs to one of ``slots`` virtual slots by a hash of its key columns,
for ever. Bytes are aggregated per slot, and only the small map from slots to
shards is edited when shards are rebalanced or added, so a record moves only if
its slot does. The map is a table with one partition for each version; a version
is never overwritten. Its size is the parameter ``slots``: it never grows with
the data, which is why it may visit the driver and be broadcast.

Null keys hash like any value (more key columns spread rows whose first key is
null or repeated), a null text counts 0 bytes, repeated rows are kept as rows of
their own, ties between slots or shards go to the smaller number, and an empty
table gives an empty result and leaves the map as it is. ``assign`` and ``place``
replace columns of the names that they make.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: ``shard[i]`` holds virtual slot ``i``."""

    version: int
    shards: int
    shard: tuple[int, ...]

    def column(self, slot: Column) -> Column:
        return F.element_at(F.from_json(F.lit(json.dumps(self.shard)), "array<int>"), slot + 1)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(self.shard)), "array<int>")).alias("slot", "shard"))
        return rows.select(F.lit(self.version).alias("version"), F.lit(self.shards).alias("shards"), "slot", "shard")


def save(mapping: SlotMap, spark: SparkSession, path: str) -> None:
    """Adds a version to the map table; one that is there already is an error."""
    mapping.table(spark).drop("version").coalesce(1).write.parquet(f"{path}/version={mapping.version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the map table, the newest by default."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).select("slot", "shards", "shard").orderBy("slot").collect()  # `slots` rows
    if not rows:
        raise LookupError(f"no version {version} in {path}")
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows))


def slot_of(key: str | list[str], slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*([key] if isinstance(key, str) else key)), F.lit(slots)).cast("int")


def slot_bytes(df: DataFrame, key: str | list[str], size: Column, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of each slot in use: at most ``slots`` rows."""
    return df.groupBy(slot_of(key, slots).alias("slot")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def _loads(stats: DataFrame, slots: int) -> list[int]:
    load = [0] * slots
    for r in stats.select("slot", "bytes").collect():
        load[r[0]] = r[1] or 0
    return load


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1, before any sizes are known: equally many slots for each shard."""
    return SlotMap(1, shards, tuple(k % shards for k in range(slots)))


def rebalance(old: SlotMap, stats: DataFrame) -> SlotMap:
    """The next version, for the loads of now: between the fullest and the emptiest shard the slot
    moves whose load comes closest to half their difference, or two slots change places; until
    neither brings them closer. Other slots stay."""
    load = _loads(stats, len(old.shard))
    totals = [0] * old.shards
    held: list[list[tuple[int, int]]] = [[] for _ in totals]
    for slot, s in enumerate(old.shard):
        totals[s] += load[slot]
        if load[slot]:
            held[s].append((load[slot], slot))
    for h in held:
        h.sort()
    shard = list(old.shard)
    for _ in range(4 * len(shard)):
        full, free = max(range(old.shards), key=lambda s: (totals[s], -s)), min(range(old.shards), key=lambda s: (totals[s], s))
        gap = totals[full] - totals[free]
        best: tuple[int, int, int] | None = None  # what is left of the gap, place in the full and in the free shard (-1: none)
        light = [(0, -1), *held[free]]
        for i, (mine, _) in enumerate(held[full]):
            j = bisect.bisect_left(light, (mine - gap / 2, -1))
            for k in (j - 1, j):
                if 0 <= k < len(light) and 0 < mine - light[k][0] < gap:
                    left = abs(gap - 2 * (mine - light[k][0]))
                    if best is None or left < best[0]:
                        best = left, i, k - 1
        if best is None:
            break
        moved = [(full, free, held[full].pop(best[1]))]
        if best[2] >= 0:
            moved.append((free, full, held[free].pop(best[2])))
        for a, b, (size, slot) in moved:
            bisect.insort(held[b], (size, slot))
            totals[a], totals[b], shard[slot] = totals[a] - size, totals[b] + size, b
    return SlotMap(old.version + 1, old.shards, tuple(shard))


def grow(old: SlotMap, stats: DataFrame) -> SlotMap:
    """One more shard: slots are taken from the fullest shards until the new one has its share; no other slot moves."""
    load = _loads(stats, len(old.shard))
    totals = [0] * (old.shards + 1)
    held: list[list[int]] = [[] for _ in totals]
    for slot, s in enumerate(old.shard):
        totals[s] += load[slot]
        held[s].append(slot)
    for h in held:
        h.sort(key=lambda s: (load[s], s))
    shard, fair = list(old.shard), sum(totals) / len(totals)
    while totals[-1] < fair:
        donor = max(range(old.shards), key=lambda s: (totals[s], s))
        slot = next((x for x in reversed(held[donor]) if load[x] <= fair - totals[-1]), None)
        if slot is None or not load[slot]:
            break
        held[donor].remove(slot)
        shard[slot] = old.shards
        totals[donor] -= load[slot]
        totals[-1] += load[slot]
    return SlotMap(old.version + 1, old.shards + 1, tuple(shard))


def assign(df: DataFrame, key: str | list[str], mapping: SlotMap) -> DataFrame:
    """``df`` with ``virtual_slot`` and ``shard``; no shuffle."""
    return df.withColumn("virtual_slot", slot_of(key, len(mapping.shard))).withColumn("shard", mapping.column(F.col("virtual_slot")))


def place(df: DataFrame, mapping: SlotMap, stats: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``slot``: the row's place in its shard, gapless from 0.

    A virtual slot is ranked by itself and begins where the shard's earlier
    slots end, so the largest sort is one slot (a ``slots``-th of the rows).
    """
    spark = df.sparkSession
    before = F.sum(F.coalesce("rows", F.lit(0))).over(W.partitionBy("shard").orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    held = mapping.table(spark).join(stats.select("slot", "rows"), "slot", "left").withColumn("_before", F.coalesce(before, F.lit(0)))
    held = F.broadcast(held.select(F.col("slot").alias("virtual_slot"), "_before"))  # `slots` rows
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order)))
    return ranked.join(held, "virtual_slot").withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_before", "_rank")
