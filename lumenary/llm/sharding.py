"""Sharding over fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots; the slots' bytes and rows are summed; a small versioned
table says which shard owns which slot. Rebalancing edits that table only: records never change their slot, so a new
version moves whole slots and nothing else. The slot table has `n_slots` rows whatever the data, so it alone may be
collected, edited on the driver and broadcast. A version is written beside its place and put there by a rename that fails if
the version exists, so of two writers one wins and a version is never stored twice.

Rows that repeat (equal doc_id, size and CRC) would share a slot however many they are. They are counted by task, numbered
from 0 by running sums of these counts, and the number is part of the hash, so they spread over all slots; a row that does
not repeat has number 0, and keeps its slot however the table is laid out in files.

Defined results: a null text has size 1 and CRC 0; a null doc_id hashes like any other value; rows that repeat keep a
row each; an empty table gives an empty result and a map whose slots are dealt out evenly; other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import checkpointed, shared_folder, table

N_SLOTS = 4096
N_SHARDS = 16
#: Rows that one numbering group holds on average; groups within a slot multiply with the data, slots do not.
ROWS_PER_GROUP = 20_000

MAP_SCHEMA = "version int, virtual_slot int, shard int, bytes long"


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the number of each row among those that are equal in all three, from 0.

    A task's equal rows are one row with a count until they are numbered, and each task numbers no more of one kind than a
    task has read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.spark_partition_id().alias("part"))
    kind = ["doc_id", "size", "text_crc32"]
    counts = read.groupBy(*kind, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*kind).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).repartition(*kind, "part")
    return first.select(*kind, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("nth"))


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and `spread`, a second hash that divides a slot where it is large."""
    key = F.xxhash64("doc_id", "text_crc32", "nth")
    return numbered(docs).select("doc_id", "size", "text_crc32", F.pmod(key, F.lit(n_slots)).cast("int").alias("virtual_slot"), F.hash(key, F.lit(7)).alias("spread"))


def slot_sizes(slotted: DataFrame) -> DataFrame:
    return slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def first_map(sizes: dict[int, int], n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> list[tuple[int, int, int, int]]:
    """Version 1: slots by falling bytes, each to the shard with the fewest bytes so far."""
    load = [(0, 0, s) for s in range(n_shards)]
    rows = []
    for slot in sorted(range(n_slots), key=lambda s: (-sizes.get(s, 0), s)):
        weight, held, shard = heapq.heappop(load)
        rows.append((1, slot, shard, sizes.get(slot, 0)))
        heapq.heappush(load, (weight + sizes.get(slot, 0), held + 1, shard))
    return sorted(rows)


def rebalance(rows: list[tuple[int, int, int, int]], sizes: dict[int, int], n_shards: int, slack: float = 0.002) -> list[tuple[int, int, int, int]]:
    """The next version: as long as a shard is over the mean by more than `slack`, its best-fitting slot moves to the lightest one.

    Slots of shards that no longer exist move as well; all other slots stay where they are.
    """
    version = max((r[0] for r in rows), default=0) + 1
    owner = {slot: shard for _, slot, shard, _ in rows}
    load = dict.fromkeys(range(n_shards), 0)
    for slot, shard in owner.items():
        if shard in load:
            load[shard] += sizes.get(slot, 0)
    for slot in sorted((s for s, shard in owner.items() if shard not in load), key=lambda s: (-sizes.get(s, 0), s)):
        owner[slot] = min(load, key=lambda s: (load[s], s))
        load[owner[slot]] += sizes.get(slot, 0)
    mean = sum(load.values()) / max(1, n_shards)
    for _ in range(len(owner)):
        heavy, light = max(load, key=lambda s: (load[s], -s)), min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fits = [s for s, shard in owner.items() if shard == heavy and 0 < sizes.get(s, 0) < gap]
        if load[heavy] <= mean * (1 + slack) or not fits:
            break
        slot = min(fits, key=lambda s: (abs(sizes.get(s, 0) - gap / 2), s))
        owner[slot] = light
        load[heavy] -= sizes.get(slot, 0)
        load[light] += sizes.get(slot, 0)
    return sorted((version, slot, shard, sizes.get(slot, 0)) for slot, shard in owner.items())


def store_map(spark: SparkSession, rows: list[tuple[int, int, int, int]], path: str) -> None:
    """Store one version in a folder of its own, or raise FileExistsError if the version is there; earlier versions stay readable."""
    [version] = {r[0] for r in rows}
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    beside, place = (hadoop.Path(f"{path}/{name}") for name in (f"_new-{uuid.uuid4()}", f"version={version}"))
    spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.parquet(beside.toString())
    files = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    try:
        # Without an option to overwrite, the rename fails where its target exists.
        files.rename(beside, place, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        files.delete(beside, True)
        if "FileAlreadyExistsException" in str(e.java_exception):
            raise FileExistsError(f"version {version} of the slot map is stored already") from e
        raise


def load_map(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[int, int, int, int]]:
    """The stored map of a version, or of the latest; a row for each slot, none where nothing is stored yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    top = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = sorted(tuple(r) for r in stored.where(F.col("version") == top).select("version", "virtual_slot", "shard", "bytes").collect())
    if [r[1] for r in rows] != list(range(len(rows))):
        raise ValueError(f"version {top} of the slot map does not give each slot one owner")
    return rows


def assign(slotted: DataFrame, slot_map: DataFrame, n_rows: int) -> DataFrame:
    """Give each record its shard and a place in it, gapless from 0.

    Places follow (virtual slot, group, doc_id): a running sum over the groups' counts gives each group's first place,
    and rows are numbered within their group, so no task ever sorts a whole shard.
    """
    per_slot = max(1, round(n_rows / ROWS_PER_GROUP / N_SLOTS))  # of the usual number of slots
    placed = (slotted.withColumn("group", F.pmod("spread", F.lit(per_slot)))
              .join(F.broadcast(slot_map.select("version", "virtual_slot", "shard")), "virtual_slot"))
    counts = placed.groupBy("shard", "virtual_slot", "group").agg(F.count("*").alias("n"))
    # Two running sums, over slots within a shard and over groups within a slot, so that neither window grows with the data.
    of_slot = counts.groupBy("shard", "virtual_slot").agg(F.sum("n").alias("n"))
    by_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    of_slot = of_slot.select("virtual_slot", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).alias("slot_first"))
    by_slot = Window.partitionBy("virtual_slot").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    of_group = counts.select("virtual_slot", "group", F.coalesce(F.sum("n").over(by_slot), F.lit(0)).alias("group_first"))
    first = of_group.join(F.broadcast(of_slot), "virtual_slot").select("virtual_slot", "group", (F.col("slot_first") + F.col("group_first")).alias("first"))
    order = Window.partitionBy("virtual_slot", "group").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("nth", F.row_number().over(order)).join(first.hint("shuffle_hash"), ["virtual_slot", "group"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), "virtual_slot", F.col("version").alias("map_version")))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Slot, size and place every record by the map stored under `map_path` (a new folder of the checkpoint folder if none is given).

    Where nothing is stored, version 1 deals the slots out in turn. The next version is an edit of the latest one by the
    slots' counted bytes, which moves as few slots as it can; it is stored, read back and applied. Records never change their
    slot, so the stored number of slots holds, and `n_slots` counts for a first map only.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4()}"
    stored = load_map(spark, path)
    if not stored:
        stored = [(1, slot, slot % n_shards, 0) for slot in range(n_slots)]
        store_map(spark, stored, path)
    slotted = checkpointed(with_slots(docs, len(stored)))
    sums = slot_sizes(slotted).collect()  # a row for each slot at most
    store_map(spark, rebalance(stored, {r["virtual_slot"]: r["bytes"] for r in sums}, n_shards), path)
    return assign(slotted, spark.createDataFrame(load_map(spark, path), MAP_SCHEMA), sum(r["n"] for r in sums))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards under the law `bytes`."""
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
