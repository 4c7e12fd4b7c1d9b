"""Sharding by fixed virtual slots (operator 12), with DataFrame and SQL functions only.

A record hashes into one of ``SLOTS`` virtual slots, for good. Bytes and rows are added up per slot,
and a map from slots to shards, one small versioned table, makes the shards' sizes nearly equal:
slots go to the shard with the least bytes, heaviest first. To rebalance, the map is edited and
saved as its next version: slots that a shard has too much of move, all others stay.

Within its shard a record's place is its number within the slot plus the rows of the shard's slots
before it, so nothing larger than a slot is ever ordered in one task. A key that many identical
records share and that alone would outweigh slots is dealt over all slots by record number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depotcast.llm.common import stored

#: Virtual slots; fixed for the life of a data set.
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: Identical records with more than this part of a shard's share of bytes are dealt over all slots.
HOT_SHARE = 1 / 8
#: How far above the mean a shard may be before ``rebalance`` takes slots from it.
SLACK = 0.02

MAP = "slot int, shard int, bytes long, records long"


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32) of every document: what its sharding needs of it."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )


def with_slots(records: DataFrame, by: Sequence[str], size: str, shards: int) -> DataFrame:
    """``records`` as a written table with their virtual slot, the hash of the ``by`` columns.

    Identical records beyond ``HOT_SHARE`` of a shard are dealt by record number: their keys are
    found among the slots that heavy, so only these slots' records are grouped. Fewer than
    shards / HOT_SHARE keys and slots can be that heavy, whatever the size of the table.
    """
    numbered = stored(records.withColumn("_record", F.monotonically_increasing_id()), "records")
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS)).cast("int")
    loads = stored(numbered.groupBy(slot.alias("slot")).agg(F.sum(size).alias("bytes")), "slot-loads")
    limit = loads.agg(F.sum("bytes") * (HOT_SHARE / shards)).scalar()
    heavy = loads.where(F.col("bytes") > limit).select("slot")
    same = [F.col(c).alias(f"_hot_{c}") for c in by]
    hot = (
        numbered.withColumn("slot", slot).join(F.broadcast(heavy), "slot")
        .groupBy(*same).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) & (F.col("_bytes") > limit)).drop("_bytes", "_n").withColumn("_hot", F.lit(True))
    )
    hot = stored(hot, "hot-keys")
    alike = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in by]
    dealt = F.pmod(F.xxhash64(*by, "_record"), F.lit(SLOTS)).cast("int")
    return (
        numbered.join(F.broadcast(hot), alike, "left")
        .withColumn("virtual_slot", F.when(F.col("_hot"), dealt).otherwise(slot))
        .drop("_hot", "_record", *[f"_hot_{c}" for c in by])
    )


def slot_loads(slotted: DataFrame, size: str) -> DataFrame:
    """(slot, bytes, records) for all ``SLOTS`` slots, empty ones too."""
    loads = slotted.groupBy(F.col("virtual_slot").alias("slot")).agg(
        F.sum(size).cast("long").alias("bytes"), F.count(F.lit(1)).alias("records")
    )
    every = slotted.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return every.join(loads, "slot", "left").na.fill(0, ["bytes", "records"])


def _deal(waiting: DataFrame, kept: DataFrame, shards: int) -> DataFrame:
    """``waiting`` slots with a shard each: the heaviest first to the shard with the least bytes.

    One fold over an array of at most ``SLOTS`` entries, with an array of the shards' loads, as
    (bytes, shard), for its state. ``kept`` has the loads to start from, by shard.
    """
    none = F.array_repeat(F.lit(0).cast("long"), shards)
    by_shard = kept.agg(F.map_from_entries(F.collect_list(F.struct("shard", "bytes")))).scalar()
    started = F.transform(none, lambda x, i: F.struct(F.coalesce(F.try_element_at("kept", i), x).alias("bytes"), i.alias("shard")))
    queue = F.sort_array(F.collect_list(F.struct(F.col("bytes"), (-F.col("slot")).alias("behind"), F.col("records"))), asc=False)

    def take(state, slot):
        least = F.array_min(state["loads"])
        loads = F.transform(
            state["loads"],
            lambda x: F.when(x["shard"] == least["shard"], F.struct((x["bytes"] + slot["bytes"]).alias("bytes"), x["shard"].alias("shard"))).otherwise(x),
        )
        return F.struct(loads.alias("loads"), F.concat(state["dealt"], F.array(least["shard"])).alias("dealt"))

    empty = F.struct(started.alias("loads"), F.array().cast("array<int>").alias("dealt"))
    return (
        waiting.agg(queue.alias("queue")).withColumn("kept", by_shard)
        .withColumn("dealt", F.aggregate("queue", empty, take, lambda s: s["dealt"]))
        .select(F.explode(F.arrays_zip("queue", "dealt")).alias("x"))
        .select(
            (-F.col("x.queue.behind")).alias("slot"), F.col("x.dealt").alias("shard"),
            F.col("x.queue.bytes").alias("bytes"), F.col("x.queue.records").alias("records"),
        )
    )


def _unused(loads: DataFrame, shards: int) -> DataFrame:
    """Empty slots have a shard as well, for what comes later."""
    return loads.where("bytes = 0 and records = 0").select(
        "slot", F.pmod("slot", F.lit(shards)).cast("int").alias("shard"), "bytes", "records"
    )


def first_map(loads: DataFrame, shards: int) -> DataFrame:
    """The first map of a data set: (slot, shard, bytes, records)."""
    nothing = loads.sparkSession.createDataFrame([], "shard int, bytes long")
    return _deal(loads.where("bytes > 0 or records > 0"), nothing, shards).unionByName(_unused(loads, shards))


def rebalance(current: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The map edited for present loads and a number of shards that may have changed.

    A shard keeps its slots, heaviest first, up to the mean and ``SLACK`` of it; the rest of an
    overfull shard, and all slots of shards that no longer exist, are dealt to those with the least.
    Within the slack nothing moves.
    """
    now = loads.join(current.select("slot", "shard"), "slot")
    limit = loads.agg(F.sum("bytes") * ((1 + SLACK) / shards)).scalar()
    down = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    running = now.withColumn("_up_to", F.sum("bytes").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    stays = (F.col("shard") < shards) & ((F.col("_up_to") <= limit) | (F.col("bytes") == 0))
    kept = running.where(stays).drop("_up_to")
    moved = running.where(~stays).drop("_up_to", "shard")
    dealt = _deal(moved, kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")), shards)
    return kept.select("slot", "shard", "bytes", "records").unionByName(dealt)


class SlotMaps:
    """The versions of a data set's map, one folder each below ``uri``."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def versions(self) -> list[int]:
        """Versions that are written to the end (Spark marks those)."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri)
        files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(folder):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("version-")]
        return sorted(int(p.getName().split("-")[1]) for p in found if files.exists(path(p, "_SUCCESS")))

    def _at(self, version: int) -> str:
        return f"{self.uri}/version-{version:06d}"

    def save(self, slot_map: DataFrame) -> int:
        """Write the next version. A folder that a broken run left behind is written over."""
        version = max(self.versions(), default=-1) + 1
        slot_map.coalesce(1).write.mode("overwrite").parquet(self._at(version))
        return version

    def load(self, version: int | None = None) -> DataFrame:
        """One version of the map, by default the latest."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no such version of the map below {self.uri}")
        return self.spark.read.schema(MAP).parquet(self._at(known[-1] if version is None else version))


def place(slotted: DataFrame, slot_map: DataFrame, order: Sequence[str]) -> DataFrame:
    """``slotted`` with its ``shard`` and the ``slot`` in it: places 0, 1, ... without gaps.

    ``slot_map`` must hold the loads of these very records. It has ``SLOTS`` rows and is broadcast.
    """
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = slot_map.select(
        F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy("virtual_slot").orderBy(*order)
    return (
        slotted.withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(bases), "virtual_slot")
        .withColumn("slot", (F.col("_base") + F.col("_place") - 1).cast("long"))
        .drop("_base", "_place")
    )


def shard_documents(docs: DataFrame, shards: int, uri: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, virtual_slot, shard, slot) of every row; the map's versions are below ``uri``.

    Law ``bytes``: the shards' sizes are nearly equal, as far as single documents allow. A document's
    virtual slot depends on its key and text alone. The first call makes the map, later ones with
    the same ``uri`` edit it. A null text is empty; rows without a key and rows that share one are
    told apart by their texts; repeated rows each have their place. Other columns are not read. An
    empty table leaves all slots empty.
    """
    if shards < 1:
        raise ValueError("there must be a shard at least")
    by = ["key", "text_crc32", "size"]
    slotted = with_slots(measure(docs, key=key, text=text), by, "size", shards)
    loads = stored(slot_loads(slotted, "size"), "slot-loads")
    maps = SlotMaps(docs.sparkSession, uri)
    maps.save(rebalance(maps.load(), loads, shards) if maps.versions() else first_map(loads, shards))
    return place(slotted, maps.load(), by).withColumnRenamed("key", key)
