"""Sharding by fixed virtual slots: rows hash into slots, bytes are summed per slot, and a versioned table maps slots to shards.

The slot of a row never changes; rebalancing edits the map. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import stored

SLOTS = 4096


def slot_of(key: str, text: str, slots: int = SLOTS) -> Column:
    """Slot from 0 by the key's text form, or by the row's text where the key is null."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")).cast("binary")), F.lit(slots)).cast("int")


def size_of(text: str) -> Column:
    """UTF-8 bytes plus one; a null text has none."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of all slots, also empty ones; `rows` has vslot and size."""
    found = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(found, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows"))


def placed(movers: DataFrame, loads: DataFrame) -> DataFrame:
    """Give each of `movers` (vslot, bytes), the largest first, to the shard that has least; `loads` has (shard, load).

    One fold over at most the number of slots; ties go to the lower shard and the lower slot.
    """
    both = movers.select("vslot", "bytes", F.lit(None).cast("int").alias("shard")).unionByName(
        loads.select(F.lit(None).cast("int").alias("vslot"), F.col("load").alias("bytes"), "shard"))
    gathered = both.agg(
        F.sort_array(F.collect_list(F.when(F.col("shard").isNull(), F.struct((-F.col("bytes")).alias("b"), "vslot")))).alias("items"),
        F.sort_array(F.collect_list(F.when(F.col("shard").isNotNull(), F.struct(F.col("bytes").alias("load"), "shard")))).alias("loads"))

    def put(acc, x):
        least = F.array_min(acc["loads"])
        fuller = F.transform(acc["loads"], lambda s: F.when(s["shard"] == least["shard"], F.struct((s["load"] - x["b"]).alias("load"), s["shard"].alias("shard"))).otherwise(s))
        return F.struct(fuller.alias("loads"), F.concat(acc["placed"], F.array(F.struct(x["vslot"].alias("vslot"), least["shard"].alias("shard")))).alias("placed"))

    none = F.expr("CAST(array() AS array<struct<vslot:int,shard:int>>)")
    folded = gathered.select(F.aggregate(
        "items", F.struct(F.col("loads"), none.alias("placed")), put, lambda acc: acc["placed"]).alias("placed"))
    return folded.select(F.explode("placed").alias("p")).select("p.vslot", "p.shard")


def edited_map(old: DataFrame, weights: DataFrame, shards: int) -> DataFrame:
    """The next version of the map (version, vslot, shard): only what a shard holds beyond an even share moves.

    A shard keeps its largest slots up to an even share; slots of shards that no longer exist move. Empty slots stay, or
    are dealt in turn.
    """
    per = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    total = weights.agg(F.sum("bytes")).first()[0]
    held = old.join(weights, "vslot").withColumns({"upto": F.sum("bytes").over(per), "share": F.lit(-(-total // shards))})
    stays = (F.col("shard") < shards) & ((F.col("upto") <= F.col("share")) | (F.col("bytes") == 0))
    return _next(held.where(stays), held.where(~stays), old.agg(F.max("version")).first()[0] + 1, shards)


def first_map(weights: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map for (vslot, bytes): largest slot first, to the shard that has least."""
    nowhere = weights.withColumn("shard", F.lit(None).cast("int"))
    return _next(nowhere.where(F.lit(False)), nowhere, 1, shards)


def _next(kept: DataFrame, movers: DataFrame, version: int, shards: int) -> DataFrame:
    spark = movers.sparkSession
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    loads = every.join(kept.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"))
    empty = movers.where("bytes = 0").select("vslot", F.pmod(F.col("vslot"), F.lit(shards)).alias("shard"))
    rows = kept.select("vslot", "shard").unionByName(placed(movers.where("bytes > 0"), loads)).unionByName(empty)
    return rows.select(F.lit(version).alias("version"), "vslot", "shard")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions of the map table that are written completely, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def save_map(slot_map: DataFrame, folder: str) -> DataFrame:
    """Write one version of the map as a folder of its own and read it back. A version that is there is never written again."""
    spark = slot_map.sparkSession
    version = slot_map.first()["version"]
    if version in versions(spark, folder):
        raise ValueError(f"version {version} of the slot map exists")
    # what a lost driver left unfinished is replaced
    slot_map.select("vslot", "shard").write.mode("overwrite").parquet(f"{folder}/version={version}")
    return load_map(spark, folder, version)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of the map table, the newest by default."""
    wanted = version if version is not None else versions(spark, folder)[-1]
    return spark.read.schema("vslot int, shard int").parquet(f"{folder}/version={wanted}").select(F.lit(wanted).alias("version"), "vslot", "shard")


def fits(slot_map: DataFrame, weights: DataFrame, shards: int, slack: float) -> bool:
    """Whether the map has these shards, and none is fuller than an even share by more than `slack` of it or its largest slot."""
    loads = slot_map.join(weights, "vslot").groupBy("shard").agg(F.sum("bytes").alias("load"), F.max("bytes").alias("largest"))
    over = F.col("load") > F.lit(1 + slack) * F.col("total") / shards + F.col("largest")
    total = weights.agg(F.sum("bytes").alias("total"))  # one row
    found = loads.join(total).agg(F.max("shard").alias("last"), F.count("*").alias("n"), F.coalesce(F.bool_or(over), F.lit(False)).alias("over")).first()
    return found["n"] == shards and found["last"] == shards - 1 and not found["over"]


def kept_map(weights: DataFrame, shards: int, folder: str, slack: float = 0.02) -> DataFrame:
    """The newest version of the map in `folder`, edited to the next one where it doesn't fit; version 1 where there is none."""
    spark = weights.sparkSession
    if not versions(spark, folder):
        return save_map(first_map(weights, shards), folder)
    newest = load_map(spark, folder)
    return newest if fits(newest, weights, shards, slack) else save_map(edited_map(newest, weights, shards), folder)


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, vslot) of each row; a null text counts as empty. Written once, as two passes read it."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return stored(docs.select(key, size_of(text).alias("size"), crc.alias("text_crc32"), slot_of(key, text, slots).alias("vslot")), "sized")


def assigned(rows: DataFrame, slot_map: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each row of `sized` with its shard and its place in the shard, gapless from 0: by virtual slot, then by key.

    The places inside a virtual slot are counted apart and the slots' counts are added up on the map, so no task sees a
    whole shard.
    """
    counts = rows.groupBy("vslot").agg(F.count("*").alias("rows"))
    offset = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    ends = slot_map.join(counts, "vslot").select("vslot", "shard", F.coalesce(offset, F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(key, "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(ends, "vslot").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot")


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", map_folder: str | None = None) -> DataFrame:
    """Put all rows into shards of near equal bytes.

    Null keys are slotted by text; null texts have size 1. Repeated rows share a slot. An empty table gives an empty result.
    With `map_folder` the map is kept there in versions: a later call takes the newest one, or edits it to the next where the
    number of shards has changed or a shard has become too full, so few rows move. Rows with equal texts have no law of
    their own and may part.
    """
    rows = sized(docs, key, text)
    weights = stored(slot_bytes(rows), "slot-bytes")
    return assigned(rows, kept_map(weights, shards, map_folder) if map_folder else stored(first_map(weights, shards), "slot-map"), key)
