"""Sharding by fixed virtual slots, in DataFrame functions only.

Records hash by id into ``slots`` virtual slots, once and for all.  Bytes are aggregated per slot, and a versioned
slot-to-shard map assigns whole slots to shards; rebalancing and growing edit the map and never rehash a record.
The map has ``slots`` rows whatever the data, so it is planned on the driver and broadcast.

Law: ``bytes``.  Slots go, largest first, to the shard with the fewest bytes, so shard sizes differ by less than the
largest slot; ``rebalance`` moves the fewest slots that bring the shards within a tolerance.  A slot that holds over
1 / (HEAVY * shards) of all bytes in two rows or more (rows of one id, or without one) is split: each of its rows goes to
the slot that the hash of its id, its text's hash and its number among equal rows names.  The map lists split slots, at
most HEAVY * shards, so that records and a stored map give the same places again (``place``).  Only a single row can't be
split.

Defined results: null text: size 1; null ids hash as the empty string; repeated rows share a slot, unless it is split,
and count each; ties in a slot are numbered in any order; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SLOTS = 4096
SHARDS = 8
#: Each slot's rows are numbered in this many parts.
PARTS = 16
#: Of the mean shard, the share that a slot may hold before it is split.
HEAVY = 32
#: Equal rows of a split slot are written out in blocks of this many.
BLOCK = 10_000


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    owner: tuple[int, ...]  # shard of each slot
    split: tuple[int, ...] = ()  # slots whose rows are dealt over all slots

    def frame(self, spark: SparkSession) -> DataFrame:
        """The map as a table, a row a slot; ``read`` takes it back."""
        held = set(self.split)
        rows = [(self.version, self.shards, s, o, s in held) for s, o in enumerate(self.owner)]
        return spark.createDataFrame(rows, "version int, shards int, vslot int, shard int, split boolean")

    @staticmethod
    def read(table: DataFrame) -> SlotMap:
        rows = sorted(table.collect(), key=lambda r: r.vslot)  # one row a slot
        return SlotMap(rows[0].version, rows[0].shards, tuple(r.shard for r in rows), tuple(r.vslot for r in rows if r.split))


def build(sizes: dict[int, int], slots: int = SLOTS, shards: int = SHARDS) -> SlotMap:
    """Version 1: the largest slot first, to the lightest shard; empty slots are dealt out in turn."""
    owner, load = [s % shards for s in range(slots)], [(0, k) for k in range(shards)]
    for slot in sorted(sizes, key=lambda s: (-sizes[s], s)):
        weight, k = heapq.heappop(load)
        owner[slot] = k
        heapq.heappush(load, (weight + sizes[slot], k))
    return SlotMap(1, shards, tuple(owner))


def rebalance(held: SlotMap, sizes: dict[int, int], shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version: slots leave the heaviest shards for the lightest (new ones start empty) until within tolerance."""
    shards = shards or held.shards
    if shards < held.shards:
        raise ValueError("shards can only be added")
    owner, load = list(held.owner), [0] * shards
    own: dict[int, list[int]] = {k: [] for k in range(shards)}
    for s in range(len(owner)):
        load[owner[s]] += sizes.get(s, 0)
        own[owner[s]].append(s)
    goal = sum(load) / shards
    for _ in range(4 * len(owner)):
        high, low = max(range(shards), key=lambda k: load[k]), min(range(shards), key=lambda k: load[k])
        gap = load[high] - load[low]
        if gap <= tolerance * goal:
            break
        fit = [s for s in own[high] if 0 < sizes.get(s, 0) < gap]
        if not fit:
            break
        s = min(fit, key=lambda x: (abs(sizes[x] - min(gap / 2, load[high] - goal if load[high] - goal > 0 else gap / 2)), x))
        own[high].remove(s)
        own[low].append(s)
        load[high] -= sizes[s]
        load[low] += sizes[s]
        owner[s] = low
    return replace(held, version=held.version + 1, shards=shards, owner=tuple(owner))


def _vslot(part):
    return F.floor(part / PARTS).cast("int")


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id, size, text_crc32, _hash, _part and vslot of every row, written once: all later steps read these few bytes a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(slots * PARTS)).cast("int")
    rows = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"), part.alias("_part"))
    return materialize(rows.withColumn("vslot", _vslot(F.col("_part"))))


def heavy_slots(rows: DataFrame, shards: int) -> tuple[int, ...]:
    """Slots of two rows or more and many bytes, at most HEAVY * shards of them."""
    per = rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()  # one row a slot
    limit = sum(r.b for r in per) / (HEAVY * shards)
    return tuple(sorted(r.vslot for r in per if r.b > limit and r.n > 1))


def dealt(rows: DataFrame, split: tuple[int, ...], *, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """The rows with those of split slots in slots of their own.

    Equal rows can't be told apart, so they are counted (map-side first) and written out again with their numbers, in
    blocks that spread over tasks: no group is sorted or held as a whole.
    """
    if not split:
        return rows
    here = F.col("vslot").isin(list(split))
    each = rows.where(here).groupBy(id_col, "size", "text_crc32", "_hash").agg(F.count("*").alias("_n"))
    blocks = each.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK))))
    first = F.col("_b") * BLOCK
    spread = blocks.repartition(id_col, "_hash", "_b").withColumn("_k", F.explode(F.sequence(first, F.least(first + BLOCK, F.col("_n")) - 1)))
    deal = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("_hash"), F.col("_k")), F.lit(slots * PARTS)).cast("int")
    moved = spread.withColumn("_part", deal).withColumn("vslot", _vslot(F.col("_part"))).select(rows.columns)
    return materialize(rows.where(~here).unionByName(moved))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    return {r.vslot: r.b for r in rows.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}  # one row a slot


def assign(rows: DataFrame, slot_map: SlotMap, *, id_col: str = "doc_id") -> DataFrame:
    """id, size, text_crc32, vslot, shard, map_version and slot: the row's gapless number within its shard.

    Numbers come from counts of small hash parts: a running sum over the parts (a table of slots * PARTS rows) gives
    each part its first number, and rows are numbered within their part only.
    """
    owners = F.broadcast(slot_map.frame(rows.sparkSession).select("vslot", "shard", F.col("version").alias("map_version")))
    counts = rows.groupBy("_part", "vslot").agg(F.count("*").alias("_n")).join(owners, "vslot")
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = F.broadcast(counts.select("_part", "shard", "map_version", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    own = W.partitionBy("_part").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("_at", F.row_number().over(own)).join(first, "_part")
    return numbered.select(id_col, "size", "text_crc32", "vslot", "shard", "map_version", (F.col("_first") + F.col("_at") - 1).cast("long").alias("slot"))


def place(docs: DataFrame, slot_map: SlotMap, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``assign`` of records by a map that exists, such as a stored one."""
    slots = len(slot_map.owner)
    rows = dealt(digest(docs, id_col=id_col, text_col=text_col, slots=slots), slot_map.split, id_col=id_col, slots=slots)
    return assign(rows, slot_map, id_col=id_col)


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shards: int = SHARDS) -> tuple[DataFrame, SlotMap]:
    rows = digest(docs, id_col=id_col, text_col=text_col, slots=slots)
    split = heavy_slots(rows, shards)
    rows = dealt(rows, split, id_col=id_col, slots=slots)
    slot_map = replace(build(slot_bytes(rows), slots, shards), split=split)
    return assign(rows, slot_map, id_col=id_col), slot_map
