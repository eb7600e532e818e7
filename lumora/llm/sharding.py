"""Sharding by fixed virtual slots (DataFrame functions only).

Records hash into a fixed number of virtual slots; bytes and rows are summed per slot; a small versioned
table maps slots to shards. Rebalancing writes a new version of that table: slots stay where they are while
their shard is within the mean load, and only the overflow moves, largest first, to the least loaded shard.
Everything that grows with the data is a scan, map-side combined sums and shuffles by hash; the map has
as many rows as there are slots, whatever the input. Versions of the map are kept as version=N under a path that the
caller names; a later run loads the latest one and edits it.

Rows that are equal in id and text are numbered, within each part of the written table first, and the number is part of
what is hashed, so that any number of copies spreads over the slots as other rows do and no window has a hot key.

Edge cases: a null or empty text has 16 bytes and CRC 0; a null doc_id is hashed like a value; a text of any length is
one record, in one slot; rows repeated in full differ by their number alone, and ties by nothing that a result shows; an
empty table gives no rows and a map whose slots keep their places; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, documents, fresh_path, written

SLOTS = 4096
SHARDS = 40
ROW_OVERHEAD = 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of each document, same (one value for each id and text) and at (a row's place: its part of the table, and there)."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return out.withColumn("same", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("at", F.monotonically_increasing_id())


def slotted(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows (written, as sized gives them) with the virtual slot of each; a row that has no copy is copy 0."""
    part = F.shiftright("at", 33)
    counts = rows.groupBy("same", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    by_same = Window.partitionBy("same").orderBy("part")  # a row for each part of the table at most
    before = F.coalesce(F.sum("n").over(by_same.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = counts.select("same", "part", before.alias("before"), (F.sum("n").over(Window.partitionBy("same"))).alias("total")).where("total > 1").drop("total")
    keys = ["same", "part"]
    rows = rows.withColumn("part", part)
    number = F.col("before") + F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1
    copies = rows.join(several, keys).withColumn("copy", number).drop("before")
    alone = rows.join(several, keys, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    slot = F.pmod(F.xxhash64("same", "copy"), F.lit(slots)).cast("int")
    return alone.unionByName(copies).withColumn("virtual_slot", slot).select("doc_id", "size", "text_crc32", "virtual_slot")


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every virtual slot, empty slots included."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))
    every = rows.sparkSession.range(0, slots, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").na.fill(0, ["slot_bytes", "slot_rows"])


def initial_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt out in turn, before any size is known."""
    return spark.range(0, slots, 1, 1).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map: version, virtual_slot, shard, moved (whether the slot changed its shard).

    Slots of a shard stay, largest first, while their sum is within the mean shard load. What is over goes,
    largest first, each to the shard with the least bytes then. Shards beyond those of the old map start empty.
    """
    at = slot_map.join(loads, "virtual_slot")
    mean = F.sum("slot_bytes").over(Window.partitionBy(F.lit(0))) / shards
    kept_sum = F.sum("slot_bytes").over(Window.partitionBy("shard").orderBy(F.desc("slot_bytes"), "virtual_slot").rowsBetween(Window.unboundedPreceding, 0))
    at = at.withColumn("stays", (F.col("shard") < shards) & (kept_sum <= mean))
    one = at.groupBy().agg(
        F.coalesce(F.max("version"), F.lit(0)).alias("version"),
        F.collect_list(F.when(F.col("stays"), F.struct("shard", "slot_bytes", "virtual_slot"))).alias("kept"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("slot_bytes")).alias("less"), "virtual_slot")))).alias("over"),
    )
    load = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate("kept", F.lit(0).cast("long"), lambda a, k: a + F.when(k["shard"] == s, k["slot_bytes"]).otherwise(0)))
    start = F.struct(load.alias("load"), F.array().cast("array<struct<virtual_slot:int,shard:int>>").alias("put"))

    def place(acc: Column, slot: Column) -> Column:
        least = (F.array_position(acc["load"], F.array_min(acc["load"])) - 1).cast("int")
        return F.struct(
            F.transform(acc["load"], lambda x, i: F.when(i == least, x - slot["less"]).otherwise(x)).alias("load"),
            F.concat(acc["put"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), least.alias("shard")))).alias("put"),
        )

    put = F.concat(
        F.transform("kept", lambda k: F.struct(k["virtual_slot"].alias("virtual_slot"), k["shard"].alias("shard"), F.lit(False).alias("moved"))),
        F.transform(F.aggregate("over", start, place)["put"], lambda p: F.struct(p["virtual_slot"].alias("virtual_slot"), p["shard"].alias("shard"), F.lit(True).alias("moved"))),
    )
    return one.select((F.col("version") + 1).alias("version"), F.inline(put))


def stored_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of the map under a path; None if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        return None
    every = spark.read.parquet(path)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == last).select("version", "virtual_slot", "shard")


def store_map(new: DataFrame, path: str) -> None:
    """Adds a version of the map under the path; a version that is there already is an error."""
    version = new.agg(F.max("version")).first()[0]
    new.select("virtual_slot", "shard", "moved").coalesce(1).write.parquet(f"{path}/version={version}")  # as many rows as slots


def shard_documents(docs: DataFrame, map_path: str, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Each document with its shard and its place there (slot, gapless from 0), by bytes per virtual slot.

    map_path: where the versions of the slot map are kept; the latest one is edited and the next one is stored.
    """
    spark = docs.sparkSession
    records = written(sized(docs), "sharding-sized")
    rows = written(slotted(records, slots), "sharding-rows")
    discard(records)
    loads = written(slot_loads(rows, slots), "sharding-loads")
    old = stored_map(spark, map_path)
    store_map(rebalanced(initial_map(spark, shards, slots) if old is None else old, loads, shards), map_path)
    new = stored_map(spark, map_path)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    places = new.join(loads, "virtual_slot").withColumn("first", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
    places = F.broadcast(places.select("virtual_slot", "shard", "version", "first"))  # as many rows as slots, whatever the input
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("within", within).join(places, "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), fresh_path(spark, "sharding-map"))
