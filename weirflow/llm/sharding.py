"""Sharding by fixed virtual slots.

Every record hashes to one of a fixed number of virtual slots (thousands, so far more than
shards). Bytes are summed per slot, which is one small row per slot at any corpus size, and
a versioned map says which shard holds each slot. Rebalancing never re-hashes a record: it
edits the newest stored map and stores it under the next version.

A slot follows from the record alone: its id, its checksum, and which of the rows that repeat
both it is, counted from 0. So a stored map finds each record again, however the files were
read, and rows that repeat are spread over the slots without a special case.

Equal texts are not kept together: law ``bytes`` asks for shards of near equal size, and a
group of copies may be larger than a shard.

Defined results for odd input: a null text has no bytes; the size of a record is its UTF-8
bytes plus one, also of very long texts, which are never split. A null id hashes like any
other value. Repeated rows differ by their count only, so which of them gets which slot is of
no consequence. An empty table gives an empty result. Only the id and text columns are read,
so other columns can have any names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fingerprints import bounded
from .staging import own_path, stage, table

SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds each virtual slot, at one version."""

    version: int
    shards: int
    owner: tuple[int, ...]
    note: str = field(default="", compare=False)

    @staticmethod
    def even(slots: int, shards: int) -> SlotMap:
        """The first version, before any size is known: as many slots in each shard."""
        return SlotMap(1, shards, tuple(slot % shards for slot in range(slots)), "even")

    def rebalance(self, sizes: list[int], shards: int | None = None) -> SlotMap:
        """The next version for new sizes and, if given, more shards.

        Slots leave the fullest shard for the emptiest while that narrows the gap, so few
        slots move, and with one more shard and unchanged sizes mostly into the new one.
        """
        shards = self.shards if shards is None else shards
        if shards < self.shards:
            raise ValueError("a map can gain shards, not lose them")
        owner = list(self.owner)
        load = [0] * shards
        held: list[list[int]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(owner):
            load[shard] += sizes[slot]
            held[shard].append(slot)
        for _ in range(2 * len(owner)):
            spare = min(range(shards), key=load.__getitem__)
            # a shard that holds one huge record may be beyond help; then the next one gives
            for full in sorted(range(shards), key=lambda x: -load[x]):
                gap = load[full] - load[spare]
                fits = [s for s in held[full] if 0 < sizes[s] < gap]
                if fits:
                    break
            else:
                break
            slot = min(fits, key=lambda s: (abs(gap - 2 * sizes[s]), s))
            held[full].remove(slot)
            held[spare].append(slot)
            owner[slot] = spare
            load[full] -= sizes[slot]
            load[spare] += sizes[slot]
        return SlotMap(self.version + 1, shards, tuple(owner), "rebalanced")

    def grow(self, sizes: list[int]) -> SlotMap:
        """The next version with one more shard, which takes slots only into itself."""
        target = sum(sizes) / (self.shards + 1)
        load = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            load[shard] += sizes[slot]
        owner, new = list(self.owner), 0
        for slot in sorted(range(len(owner)), key=lambda i: (-sizes[i], i)):
            shard = owner[slot]
            if sizes[slot] and new + sizes[slot] <= target and load[shard] - sizes[slot] >= 0.98 * target:
                owner[slot], new = self.shards, new + sizes[slot]
                load[shard] -= sizes[slot]
        return SlotMap(self.version + 1, self.shards + 1, tuple(owner), "grown")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's table; a version that is there is never rewritten."""
        n = len(self.owner)
        cols = {"version": pa.array([self.version] * n, pa.int32()), "shards": pa.array([self.shards] * n, pa.int32()), "slot": pa.array(range(n), pa.int32()), "shard": pa.array(self.owner, pa.int32()), "note": [self.note] * n}
        spark.createDataFrame(pa.table(cols)).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version:08d}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A version, or the newest one; None if nothing is stored."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if version is None:
            found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
            kept = [int(n.removeprefix("version=")) for n in found if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
            if not kept:
                return None
            version = max(kept)
        rows = spark.read.parquet(f"{path}/version={version:08d}").orderBy("slot").collect()
        return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows), rows[0].note)

    def column(self, slot: Column) -> Column:
        """The shard of a slot: a constant array of as many entries as there are slots."""
        return F.element_at(F.lit(list(self.owner)), slot + 1)


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per record: id, size in bytes, checksum, its virtual slot, and which task read it.

    The count among rows of equal id and checksum is 0 but for repeated ones. Those are numbered
    per task and shifted by what earlier tasks have, so no group of them goes to one task.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = stage(rows.withColumn("part", F.spark_partition_id()).withColumn("rid", F.monotonically_increasing_id()), "records")
    again = stage(rows.groupBy("doc_id", "text_crc32").count().where("count > 1").select("doc_id", "text_crc32"), "repeated")
    few = again.count()
    if few:
        same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_crc32") == F.col("y.text_crc32"))
        marked = rows.alias("x").join(bounded(again.withColumn("twice", F.lit(True)), few).alias("y"), same, "left").select("x.*", "y.twice")
        copies = marked.where("twice").drop("twice")
        before = F.sum("n").over(Window.partitionBy("doc_id", "text_crc32").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        base = copies.groupBy("doc_id", "text_crc32", "part").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "text_crc32", "part", F.coalesce(before, F.lit(0)).alias("base"))
        own = F.row_number().over(Window.partitionBy("doc_id", "text_crc32", "part").orderBy("rid")) - 1
        numbered = copies.withColumn("own", own).alias("x").join(base.alias("y"), same & (F.col("x.part") == F.col("y.part")))
        copies = numbered.select("x.doc_id", "x.size", "x.text_crc32", "x.part", "x.rid", (F.col("own") + F.col("base")).alias("nth"))
        rows = marked.where("twice IS NULL").drop("twice").withColumn("nth", F.lit(0).cast("long")).unionByName(copies)
    else:
        rows = rows.withColumn("nth", F.lit(0).cast("long"))
    return rows.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "text_crc32", "nth"), F.lit(slots)).cast("int").alias("virtual_slot"), "part", "rid")


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: a fixed number of sums, whatever the corpus."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        sizes[r.virtual_slot], counts[r.virtual_slot] = r.b, r.n
    return sizes, counts


def assign(docs: DataFrame, shards: int = 16, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None) -> tuple[DataFrame, SlotMap]:
    """Records with their shard and place in it, and the map behind that.

    The newest map under ``map_path`` is edited for the records' sizes and stored as the next
    version, which the shards are read from; without one, an even map is stored first. Places
    are gapless from 0 in each shard. They are numbered per reading task and shard and then
    shifted by what earlier tasks gave that shard, so no sort holds more than one task's rows,
    however few shards there are.
    """
    spark = docs.sparkSession
    path = map_path or own_path(spark, "slot-map")
    rows = records(docs, id_col, text_col, slots)
    sizes, _ = slot_sizes(rows, slots)
    known = SlotMap.load(spark, path)
    if known is None:
        known = SlotMap.even(slots, shards)
        known.save(spark, path)
    known.rebalance(sizes, shards).save(spark, path)
    owners = SlotMap.load(spark, path)
    rows = rows.withColumn("shard", owners.column(F.col("virtual_slot")))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = rows.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n")).select("part", "shard", F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("part", "shard").orderBy("rid")).cast("long") - 1
    placed = rows.select("*", place.alias("place")).join(base, ["part", "shard"])
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(owners.version).alias("map_version")), owners


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed, _ = assign(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


QUERIES = {"op1_virtual_slots": op1_virtual_slots}
SQL: dict[str, str] = {}
