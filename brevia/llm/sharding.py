"""Sharding by fixed virtual slots.

A record's key is hashed into one of a fixed number of slots and never changes its
slot.  A small table says which shard has which slot.  That map carries a version;
rebalancing writes a next version in which as few slots as possible have moved.
Only DataFrame functions are used.

* Null text: 0 bytes of text.  Null key: the text takes its place in the hash.
* Repeated rows share a slot; each is a row of its own there.
* An empty table: no rows, and a map that shares out the slots evenly.
* Versions are kept in a folder that the caller names, one folder each, and outlive the
  session; a version that is there is never overwritten.
* Columns beside the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.writers import scratch_path
from .common import crc32, stored, table

SLOTS = 8192
RECORD_BYTES = 8
MAP_SCHEMA = "version INT, slot INT, shard INT, bytes BIGINT, n_rows BIGINT"


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    hashed = F.xxhash64(F.coalesce(key.cast("string"), F.concat(F.lit("text:"), text)))
    return F.pmod(hashed, F.lit(slots)).cast("int")


def sizes(docs: DataFrame, key: str, text: str, slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot) of each record, without its text."""
    length = F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    return docs.select(
        F.col(key),
        (length + RECORD_BYTES).cast("long").alias("size"),
        crc32(F.col(text)).alias("text_crc32"),
        virtual_slot(F.col(key), F.col(text), slots).alias("virtual_slot"),
    )


def slot_stats(sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Bytes and rows of every slot, empty ones included.  Each task sends one row for
    each slot at most."""
    seen = sized.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows")
    )
    every = sized.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(seen, F.col("slot") == F.col("virtual_slot"), "left").select(
        "slot", F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def first_map(stats: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal ranges of slots, whatever they hold."""
    shard = F.floor(F.col("slot") * shards / slots).cast("int")
    return stats.select(F.lit(1).alias("version"), "slot", shard.alias("shard"), "bytes", "n_rows")


def rebalanced(slot_map: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of the map.

    Slots are gone through from the largest: one stays where it is while its shard has
    room up to the mean; the others go, largest first, to the shard with least.  The
    walk is one row with an entry for each slot, so its size is fixed by the number of
    slots and does not grow with the records.
    """
    entries = slot_map.select("version", "slot", "shard").join(stats, "slot").agg(
        F.max("version").alias("version"),
        F.ceil(F.sum("bytes") / shards).alias("room"),
        F.sort_array(F.collect_list(F.struct(
            (-F.col("bytes")).alias("order"), "slot", "shard", "bytes", "n_rows"
        ))).alias("entries"),
    )
    entry = "struct(x.slot AS slot, CAST({} AS INT) AS shard, x.bytes AS bytes, x.n_rows AS n_rows)"
    none = "CAST(array() AS array<struct<slot:int,shard:int,bytes:bigint,n_rows:bigint>>)"
    add = "transform({}, (l, i) -> l + IF(i = {}, x.bytes, 0))"
    stays = f"(x.shard < {shards} AND a.loads[x.shard] + x.bytes <= room)"
    kept = entries.selectExpr("version", f"""aggregate(entries,
        struct(array_repeat(0L, {shards}) AS loads, {none} AS kept, {none} AS moving),
        (a, x) -> struct(
            IF{stays[:-1]}, {add.format('a.loads', 'x.shard')}, a.loads) AS loads,
            IF{stays[:-1]}, concat(a.kept, array({entry.format('x.shard')})), a.kept) AS kept,
            IF{stays[:-1]}, a.moving, concat(a.moving, array({entry.format('x.shard')}))) AS moving)
        ) AS a""").selectExpr("version", "a.loads AS loads", "a.kept AS kept", "a.moving AS moving")
    least = "array_position(a.loads, array_min(a.loads)) - 1"
    dealt = kept.selectExpr("version", f"""concat(kept, aggregate(moving,
        struct(loads, {none} AS dealt),
        (a, x) -> struct({add.format('a.loads', least)} AS loads,
            concat(a.dealt, array({entry.format(least)})) AS dealt),
        a -> a.dealt)) AS dealt""")
    return dealt.selectExpr("CAST(version + 1 AS INT) AS version", "inline(dealt)")


def positions(sized: DataFrame, slot_map: DataFrame, key: str) -> DataFrame:
    """Adds shard and the row's place in it, without gaps from 0.

    Rows are ranked in their virtual slot, of which there are thousands; where a slot
    begins in its shard follows from the map's counts.  The map has a fixed number of
    rows and is broadcast.
    """
    order = Window.partitionBy("shard").orderBy("slot")
    begins = slot_map.select(
        F.col("slot").alias("virtual_slot"), "version", "shard",
        (F.sum("n_rows").over(order) - F.col("n_rows")).alias("begins"),
    )
    rank = F.row_number().over(
        Window.partitionBy("virtual_slot").orderBy(key, "size", "text_crc32")
    )
    ranked = sized.withColumn("rank_in_slot", rank).join(F.broadcast(begins), "virtual_slot")
    return ranked.select(
        key, "size", "text_crc32", "shard",
        (F.col("begins") + F.col("rank_in_slot") - 1).cast("long").alias("slot"),
        "virtual_slot", F.col("version").alias("map_version"),
    )


def save_map(slot_map: DataFrame, path: str) -> DataFrame:
    """Stores one version of the map in its own folder of ``path``, which must be new, and
    returns it as stored."""
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").write.parquet(f"{path}/version={version}")
    return load_map(slot_map.sparkSession, path, version)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the last one if none is named."""
    versions = spark.read.schema(MAP_SCHEMA).parquet(path).select("version", "slot", "shard", "bytes", "n_rows")
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == version)


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text",
                    slots: int = SLOTS, earlier: DataFrame | None = None,
                    path: str | None = None) -> DataFrame:
    """Every record with its shard and place, by a map balanced over the shards' bytes.

    The map is the next version of ``earlier``, a map of as many slots, of which as few
    slots as possible move; without it, of equal ranges.  It is stored in ``path``, else in
    the scratch folder, before records are placed.
    """
    sized = sizes(docs, key, text, slots)
    stats = slot_stats(sized, slots)
    if earlier is None:
        earlier = first_map(stats, shards, slots)
    after = rebalanced(earlier, stats, shards)
    slot_map = save_map(stored(after, "slot-map"), path) if path else stored(after, "slot-map")
    return positions(sized, slot_map, key)


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 1 is stored, read again and edited into version 2, which places the rows."""
    docs, path = table(spark, sf_dir, "documents"), scratch_path(spark, "slot-maps")
    save_map(first_map(slot_stats(sizes(docs, "doc_id", "text")), 24), path)
    placed = shard_documents(docs, earlier=load_map(spark, path), path=path)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
