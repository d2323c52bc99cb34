"""Sharding by fixed virtual slots.

A record's slot is a hash of its id, among a fixed number of slots that is far above any number of
shards. A versioned map says which shard each slot is in. The map is edited, never made anew:
rebalancing moves single slots from full shards to empty ones until sizes are near equal, and
growing gives a new shard slots of all others, so all other records stay where they are.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.common import shared_dir, staged

SLOTS = 4096
#: Bytes that a record takes besides its text.
RECORD_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] for every slot; version goes up by one with every edit."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def rebalanced(self, size_of: dict[int, int], tolerance: float = 0.001) -> SlotMap:
        """Moves slots (size_of: bytes by slot) between the fullest and the emptiest shard while that evens them out.

        Each step moves the slot nearest to half the difference, or swaps one for one of the emptiest
        shard's 64 smallest; it ends when the difference is within `tolerance` of a shard's mean, can't
        be made smaller, or after eight steps a slot.
        """
        shard_of = list(self.shard_of)
        load = [0] * self.shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(shard_of):
            if size := size_of.get(slot, 0):
                load[shard] += size
                held[shard].append((size, slot))
        for h in held:
            h.sort()
        by_load, slack = sorted((n, s) for s, n in enumerate(load)), tolerance * sum(load) / self.shards
        stuck = 0  # fullest shards that have nothing fit to give, such as one very large slot
        for _ in range(8 * len(shard_of)):
            if stuck >= self.shards - 1:
                break
            (low, to), (high, frm) = by_load[0], by_load[-1 - stuck]
            gap = high - low
            if gap <= max(1, slack):
                break
            best = None  # (what is left of the gap, slot that goes, slot that comes)
            for size, slot in self._near(held[frm], gap / 2):
                if size < gap:
                    best = min((x for x in (best, (abs(gap - 2 * size), (size, slot), None)) if x), key=lambda x: x[0])
            if best is None or best[0] > slack:
                for small in held[to][:64]:
                    for size, slot in self._near(held[frm], small[0] + gap / 2):
                        if 0 < size - small[0] < gap:
                            best = min((x for x in (best, (abs(gap - 2 * (size - small[0])), (size, slot), small)) if x), key=lambda x: x[0])
            if best is None:
                stuck += 1
                continue
            _, goes, comes = best
            for item, a, b in ((goes, frm, to), (comes, to, frm)):
                if item:
                    held[a].remove(item)
                    insort(held[b], item)
                    shard_of[item[1]] = b
                    load[a] -= item[0]
                    load[b] += item[0]
            by_load = sorted((n, s) for s, n in enumerate(load))
            stuck = 0
        return replace(self, version=self.version + 1, shard_of=tuple(shard_of))

    @staticmethod
    def _near(items: list[tuple[int, int]], size: float) -> list[tuple[int, int]]:
        k = bisect_left(items, (size, -1))
        return items[max(0, k - 1) : k + 1]

    def grown(self) -> SlotMap:
        """One more shard, which takes its share of slots evenly from the others; nothing else moves."""
        new, shard_of = self.shards, list(self.shard_of)
        held = [[s for s, x in enumerate(shard_of) if x == k] for k in range(new)]
        for _ in range(len(shard_of) // (new + 1)):
            shard_of[max(held, key=len).pop()] = new
        return SlotMap(self.version + 1, new + 1, tuple(shard_of))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, x) for s, x in enumerate(self.shard_of)], "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the maps stored at path."""
        self.table(spark).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest."""
        maps = spark.read.parquet(path)
        version = maps.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted((r["virtual_slot"], r["shard"], r["shards"]) for r in maps.where(F.col("version") == version).collect())
        return cls(version, rows[0][2], tuple(r[1] for r in rows))


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) for every row of docs."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def shard(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, split: int = 256) -> DataFrame:
    """Puts every row of docs (doc_id long, text string) into a shard; shards' bytes come out near equal.

    The latest map stored at map_path is taken (without a path, a first one is made in the shared
    folder) and rebalanced by the bytes of each slot; the new version is stored beside it. Returns doc_id, size, text_crc32, virtual_slot, shard, slot
    (0, 1, 2, ... inside each shard) and map_version. A null or empty text has RECORD_BYTES bytes.
    Repeated rows and rows with a null doc_id share a slot; a slot that holds more than a `split`th
    of a shard's mean bytes because of them is dealt, by a row number fixed as the records are written, into parts,
    which go to the emptiest shards, the map's own choice first. There are at most shards * split such
    parts, so the tables of slots and parts are small whatever the data. Extra columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = staged(records(docs, slots).withColumn("row", F.monotonically_increasing_id()), "records")
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).collect()
    total = sum(r["bytes"] for r in found)
    most = max(1, total // max(1, shards * split))
    # A slot of many ids is as large as others; one that few ids make large is dealt.
    hot = {r["virtual_slot"]: -(-r["bytes"] // most) for r in found if r["bytes"] > most and r["n"] > 4 * (r["ids"] + 1)}
    if map_path:
        path, before = map_path, SlotMap.load(spark, map_path)
    else:
        path, before = f"{shared_dir(spark)}/slot-maps-{uuid.uuid4().hex}", SlotMap.first(shards, slots)
        before.save(spark, path)
    now = before.rebalanced({r["virtual_slot"]: r["bytes"] for r in found if r["virtual_slot"] not in hot})
    now.save(spark, path)
    table = [(s, 0, 1, now.shard_of[s], now.version) for s in range(slots) if s not in hot]
    if hot:
        load = [0] * now.shards
        for r in found:
            if r["virtual_slot"] not in hot:
                load[now.shard_of[r["virtual_slot"]]] += r["bytes"]
        parts = spark.createDataFrame(list(hot.items()), "virtual_slot int, parts int")
        dealt = rows.join(parts, "virtual_slot").groupBy("virtual_slot", "parts", _part().alias("part")).agg(F.sum("size").alias("bytes"))
        for r in sorted(dealt.collect(), key=lambda r: (-r["bytes"], r["virtual_slot"], r["part"])):
            to = min(range(now.shards), key=lambda k: (load[k], k != now.shard_of[r["virtual_slot"]], k))
            load[to] += r["bytes"]
            table.append((r["virtual_slot"], r["part"], r["parts"], to, now.version))
    slots_of = spark.createDataFrame(table, "virtual_slot int, part int, parts int, shard int, map_version int")
    counts = spark.createDataFrame([(s, hot.get(s, 1)) for s in range(slots)], "virtual_slot int, parts int")
    placed = rows.join(F.broadcast(counts), "virtual_slot").withColumn("part", _part())  # a row per slot
    placed = placed.join(F.broadcast(slots_of.drop("parts")), ["virtual_slot", "part"])  # a row per slot and part
    sizes = placed.groupBy("shard", "virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))
    before_ = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sizes.select("virtual_slot", "part", F.coalesce(F.sum("n").over(before_), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32", "row")) - 1
    placed = placed.withColumn("inside", inside).join(F.broadcast(ahead), ["virtual_slot", "part"])  # a row per slot and part
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("ahead") + F.col("inside")).alias("slot"), "map_version")


def _part() -> F.Column:
    return F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")


def digest(placed: DataFrame) -> DataFrame:
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
