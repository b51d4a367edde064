"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; a versioned table maps slots to shards. Version 0 deals the slots out in
turn. rebalanced() adds up the bytes of each slot and edits the map: a slot keeps its shard while that stays below the mean,
others move to the lightest shard, largest first. Only the map changes when data grow or shards are added; the record-to-slot
hash never does. SlotMaps keeps the versions in a folder, so that the next run edits the last map instead of starting anew.
All steps are DataFrame or SQL functions; the only single-task step handles one row for each virtual slot.

Null texts count as empty. Rows are hashed by id, size and checksum, so rows of one id, null or not, are spread; rows that are
equal in all three are counted first, numbered and spread by their number, each placed for itself. An empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import file_system
from .common import cell_bits, spread, written

SLOTS = 4096
RUN = 1 << 16
MAP = "version int, vslot int, shard int"


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0 of the slot-to-shard map: (version, vslot, shard)."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, edited so that the shards' bytes are near equal.

    slot_bytes: (vslot, bytes). A fold over the slots, largest first, keeps a slot where it is if its shard then stays
    within the mean, and else moves it to the shard that is lightest so far. Shards that the old map does not name fill up
    the same way, so growing from n to n + 1 shards is the same edit.
    """
    each = slot_map.join(slot_bytes, "vslot", "left").select("version", F.struct((-F.coalesce("bytes", F.lit(0))).alias("neg"), "vslot", "shard").alias("s"))
    one = each.agg(F.max("version").alias("version"), F.array_sort(F.collect_list("s")).alias("s"), (-F.sum("s.neg")).alias("total"))

    def step(acc, s):
        fits = F.element_at(acc["load"], s["shard"] + 1) - s["neg"] <= acc["mean"]
        home = F.when(fits, s["shard"]).otherwise(F.array_position(acc["load"], F.array_min(acc["load"])).cast("int") - 1)
        return F.struct(
            F.transform(acc["load"], lambda x, i: F.when(i == home, x - s["neg"]).otherwise(x)).alias("load"),
            F.concat(acc["map"], F.array(F.struct(s["vslot"].alias("vslot"), home.alias("shard")))).alias("map"),
            acc["mean"].alias("mean"),
        )

    # The mean of the shards that no single slot overfills.
    fair = F.aggregate(
        F.slice("s", 1, max(1, shards - 1)),
        F.struct(F.col("total").alias("t"), F.lit(shards).alias("k")),
        lambda acc, s: F.when((acc["k"] > 1) & (-s["neg"] * acc["k"] > acc["t"]), F.struct((acc["t"] + s["neg"]).alias("t"), (acc["k"] - 1).alias("k"))).otherwise(acc),
    )
    mean = F.ceil(fair["t"] / fair["k"]).cast("long")
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("load"),
        F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("map"),
        mean.alias("mean"),
    )
    edited = one.select((F.col("version") + 1).alias("version"), F.aggregate("s", start, step)["map"].alias("m"))
    return edited.select("version", F.inline("m"))


class SlotMaps:
    """The versions of a slot-to-shard map, as tables in a folder; a version is written once and never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        fs, p = file_system(self.spark, self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        done = [n for n in names if n.startswith("version=") and fs.exists(file_system(self.spark, f"{self.path}/{n}/_SUCCESS")[1])]
        return sorted(int(n.split("=")[1]) for n in done)

    def latest(self) -> DataFrame | None:
        """(version, vslot, shard) of the last version; None if there is none."""
        found = self.versions()
        return self.read(found[-1]) if found else None

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema(MAP).parquet(f"{self.path}/version={version}")

    def append(self, slot_map: DataFrame) -> DataFrame:
        """Writes a map under its version, of which there must be none, and gives it back as read."""
        version = slot_map.agg(F.max("version")).first()[0]
        if version is not None and version not in self.versions():
            slot_map.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        elif version is not None:
            raise FileExistsError(f"{self.path} has a version {version}")
        return self.read(version) if version is not None else slot_map


def _counted(narrow: DataFrame) -> DataFrame:
    """A row for each row of narrow, with its number among equal rows; equal rows are counted, not gathered."""
    counts = narrow.groupBy(*narrow.columns).agg(F.count("*").alias("n"))
    runs = counts.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    return runs.withColumn("number", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("n")) - 1))).drop("n", "run")


def placed(docs: DataFrame, shards: int = 16, slots: int = SLOTS, slot_map: DataFrame | None = None, rows_per_cell: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(rows, edited map). Rows: doc_id, size, text_crc32, vslot, version, shard, slot (its place in the shard, gapless from 0),
    one for each document. The map is the given one, or version 0, after one edit for these documents' bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = written(_counted(narrow).select("*", spread(F.col("doc_id"), F.col("size"), F.col("text_crc32"), F.col("number")).alias("key")), "shard")
    bits = cell_bits(rows.count() // slots, rows_per_cell)
    rows = rows.withColumn("vslot", F.pmod("key", F.lit(slots)).cast("int")).withColumn("cell", F.shiftright("key", 60 - bits))
    cells = rows.groupBy("vslot", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    slot_bytes = cells.groupBy("vslot").agg(F.sum("bytes").alias("bytes"))
    edited = written(rebalanced(slot_map if slot_map is not None else first_map(spark, shards, slots), slot_bytes, shards), "map")
    before = Window.partitionBy("shard").orderBy("vslot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.join(edited, "vslot").select("vslot", "cell", "version", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("vslot", "cell").orderBy("key", "doc_id", "size", "text_crc32")
    out = rows.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, ["vslot", "cell"])
    return out.select("doc_id", "size", "text_crc32", "vslot", "version", "shard", (F.col("offset") + F.col("inside")).alias("slot")), edited


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, maps: SlotMaps | None = None, rows_per_cell: int = 50_000) -> DataFrame:
    """placed()'s rows. maps: where the last map is read from and the edited one is kept."""
    rows, edited = placed(docs, shards, slots, maps.latest() if maps else None, rows_per_cell)
    if maps:
        maps.append(edited)
    return rows
