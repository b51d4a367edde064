"""Changes of a graph as an append-only table, and subscribers that follow it as a stream.

A change is a row (version, kind, op, id, payload): op is add, remove or change of a vertex, edge or type; payload is the object
as JSON, as it is after the change or was before its removal. A session writes what each statement changes; for two graphs
without a session between them the difference can be taken. Subscribers get each batch once, from a checkpoint on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import PropertyGraph, union
from ..plans.scratch import file_system
from ..sources.storage import save

CHANGE = "version bigint, kind string, op string, id string, payload string"


def _content(frame: DataFrame):
    """All columns but id and seq as one comparable value; maps as sorted entries."""
    kinds = {f.name: f.dataType.typeName() for f in frame.schema.fields}
    return F.to_json(F.struct(*[F.sort_array(F.map_entries(c)).alias(c) if kinds[c] == "map" else F.col(c) for c in frame.columns if c not in ("id", "seq")]))


def changes(old: PropertyGraph, new: PropertyGraph, version: int) -> DataFrame:
    """What differs between two graphs."""
    parts = []
    for kind, a, b in (("vertex", old.vertices, new.vertices), ("edge", old.edges, new.edges), ("type", old.types, new.types)):
        before = a.select("id", _content(a).alias("was"))
        after = b.select("id", _content(b).alias("now"))
        op = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "remove").when(F.col("was") != F.col("now"), "change")
        payload = F.coalesce("now", "was").alias("payload")
        parts.append(before.join(after, "id", "full").select(F.lit(version).cast("bigint").alias("version"), F.lit(kind).alias("kind"), op.alias("op"), "id", payload).where("op IS NOT NULL"))
    return union(parts)


def change_rows(spark: SparkSession, parts: list[tuple[str, str, DataFrame]], version: int) -> DataFrame:
    """Change rows of (kind, op, objects), without comparing graphs."""
    rows = [f.select(F.lit(version).cast("bigint").alias("version"), F.lit(kind).alias("kind"), F.lit(op).alias("op"), "id", _content(f).alias("payload")) for kind, op, f in parts]
    return union(rows) if rows else spark.createDataFrame([], CHANGE)


class ChangeLog:
    """A change log in a folder that all writers and subscribers reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, old: PropertyGraph, new: PropertyGraph, version: int) -> None:
        """Appends the difference of two graphs."""
        self.write(changes(old, new, version))

    def write(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/log")

    def last_version(self) -> int:
        fs, p = file_system(self.spark, f"{self.path}/log")
        return (self.read().agg(F.max("version")).first()[0] or 0) if fs.exists(p) else 0

    def read(self) -> DataFrame:
        return self.spark.read.schema(CHANGE).parquet(f"{self.path}/log")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(CHANGE).parquet(f"{self.path}/log")

    def follow(self, subscriber: Callable[[DataFrame, int], None], name: str, *, kind: str | None = None, op: str | None = None, once: bool = True) -> StreamingQuery:
        """Calls subscriber(batch, batch id) for new changes, of one kind or operation if given. once: stop when caught up."""
        frame = self.stream()
        if kind is not None:
            frame = frame.where(F.col("kind") == kind)
        if op is not None:
            frame = frame.where(F.col("op") == op)
        writer = frame.writeStream.foreachBatch(subscriber).option("checkpointLocation", f"{self.path}/subscribers/{name}")
        return (writer.trigger(availableNow=True) if once else writer).start()


def autosave(current: Callable[[], PropertyGraph], path: str) -> Callable[[DataFrame, int], None]:
    """A subscriber that saves the current graph over the one at path whenever something has changed; a Session saves by itself
    with autosave=True."""

    def on_batch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(current(), path, mode="overwrite")

    return on_batch
