"""Changes to a graph. Each gives a new graph; what could not be added or removed comes back beside it.

A change is a plan over the old tables, so it happens as a whole or not at all. Endpoints, uniqueness and cascades are
semi- and anti-joins, for one object as for many. New rows are written when they get their ids and numbers, so that both stay
as they are whatever is run again later.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attributes import literals, upserted
from ..model import EDGE, TYPE, VERTEX, PropertyGraph
from ..plans.scratch import appended, written

#: Rows of a batch that a task takes where a large batch is dealt by key.
ROWS_A_TASK = 250_000
#: Keys (some tens of bytes each, about 100 in a hash table) up to which they are broadcast, so that large tables lie still.
FEW = 1_500_000


def _numbered(new: DataFrame, old: DataFrame, schema: str) -> DataFrame:
    """new as a written table, with ids where they are null and sequence numbers above the old ones."""
    top = old.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top")).first()["top"]
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema).fields}
    out = new.withColumn("id", F.coalesce("id", F.expr("uuid()"))).withColumn("seq", F.lit(top + 1) + F.monotonically_increasing_id())
    return written(out.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]))


def _split_new(new: DataFrame, old: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to add, rows rejected): keys that exist, and all but the first of a key in the batch, are rejected."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy("seq" if "seq" in new.columns else key))
    own, unnamed = new.columns, new.where(F.col(key).isNull())  # without a key: none of them is taken, and none need meet
    new = new.where(F.col(key).isNotNull())
    n = new.select(key).count()
    large = n > FEW
    # A large batch and the old keys are dealt by key over so many tasks that each holds a bounded number of rows, however
    # well they compress; adaptive execution, which counts compressed bytes, leaves a given number as it is.
    n_tasks = -(-max(n, old.select(key).count()) // ROWS_A_TASK) if large else 1
    dealt = lambda frame, c: frame.repartition(n_tasks, c) if large else frame
    new = written(dealt(new, key).withColumn("_turn", turn))
    # Only the old keys that the batch names matter: they are found by a semi-join, and the large table is not shuffled for
    # a batch that is counted to be small.
    keys = old.select(F.col(key).alias("_k"))
    if not large:
        keys = keys.join(F.broadcast(new.select(F.col(key).alias("_k"))), "_k", "left_semi")
    taken, new = dealt(keys, "_k").distinct().withColumn("_taken", F.lit(True)), dealt(new, key)
    marked = new.join(taken, F.col(key) == F.col("_k"), "left")
    ok = F.col("_taken").isNull() & (F.col("_turn") == 1)
    return marked.where(ok).select(*own).unionByName(unnamed), marked.where(~ok).select(*own)


def few(keys: DataFrame, most: int | None = None) -> DataFrame:
    """keys, to be broadcast if they are counted to be few."""
    most = FEW if most is None else most
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def add_vertices(g: PropertyGraph, new: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """new: (id, type_id, attrs). Rejects ids that exist."""
    added, rejected = _split_new(new, g.vertices)
    return replace(g, vertices=appended(g.vertices, _numbered(added, g.vertices, VERTEX))), rejected


def add_edges(g: PropertyGraph, new: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """new: (id, src, dst, attrs). Rejects ids that exist and edges without both endpoints in the graph."""
    added, rejected = _split_new(new, g.edges)
    ends = new.select(F.explode(F.array("src", "dst")).alias("_v")).distinct()
    known = g.vertices.select(F.col("id").alias("_v")).join(few(ends), "_v", "left_semi").distinct()
    s, d = known.withColumnRenamed("_v", "_s"), known.withColumnRenamed("_v", "_d")
    marked = added.join(s, F.col("src") == F.col("_s"), "left").join(d, F.col("dst") == F.col("_d"), "left")
    ok = F.col("_s").isNotNull() & F.col("_d").isNotNull()
    good, lost = marked.where(ok).select(*added.columns), marked.where(~ok).select(*added.columns)
    return replace(g, edges=appended(g.edges, _numbered(good, g.edges, EDGE))), rejected.unionByName(lost)


def add_types(g: PropertyGraph, new: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """new: (id, name, attr_order, attrs). Rejects names and ids that exist, and empty names."""
    named = new.where("name IS NOT NULL AND name <> ''")
    added, rejected = _split_new(named, g.types, "name")
    added, twice = _split_new(added, g.types, "id")
    nameless = new.where("name IS NULL OR name = ''")
    return replace(g, types=appended(g.types, _numbered(added, g.types, TYPE))), rejected.unionByName(twice).unionByName(nameless)


def _split_known(ids: DataFrame, old: DataFrame) -> DataFrame:
    """The ids that do not exist."""
    return ids.select("id").distinct().join(old.select("id"), "id", "left_anti")


def remove_vertices(g: PropertyGraph, ids: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """Removes vertices with their edges. Gives back ids that were not there."""
    gone = few(written(ids.select("id").distinct(), "gone"))
    edges = g.edges
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("id").alias("_gone")), F.col(end) == F.col("_gone"), "left_anti")
    return replace(g, vertices=g.vertices.join(gone, "id", "left_anti").select(*g.vertices.columns), edges=edges), _split_known(ids, g.vertices)


def edges_at(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with an end among the vertices ids."""
    at = few(written(ids.select(F.col("id").alias("_at")).distinct(), "gone"))
    out = edges.join(at, F.col("src") == F.col("_at"), "left_semi")
    return out.unionByName(edges.join(at, F.col("dst") == F.col("_at"), "left_semi").join(at, F.col("src") == F.col("_at"), "left_anti"))


def remove_edges(g: PropertyGraph, ids: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    gone = ids.select("id").distinct()
    return replace(g, edges=g.edges.join(gone, "id", "left_anti").select(*g.edges.columns)), _split_known(ids, g.edges)


def remove_types(g: PropertyGraph, ids: DataFrame) -> tuple[PropertyGraph, DataFrame]:
    """Removes types; their vertices stay, without a type."""
    gone = ids.select("id").distinct()
    freed = g.vertices.join(gone.select(F.col("id").alias("_gone")), F.col("type_id") == F.col("_gone"), "left")
    freed = freed.withColumn("type_id", F.when(F.col("_gone").isNull(), F.col("type_id"))).select(*g.vertices.columns)
    return replace(g, vertices=freed, types=g.types.join(gone, "id", "left_anti").select(*g.types.columns)), _split_known(ids, g.types)


def remove_type_named(g: PropertyGraph, name: str) -> PropertyGraph:
    return remove_types(g, g.types.where(F.col("name") == name))[0]


def _changed(frame: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    return frame.withColumn(column, F.when(F.coalesce(where, F.lit(False)), value).otherwise(F.col(column)))


def set_attributes(g: PropertyGraph, where: Column, attrs: dict[str, Any], on: str = "vertices") -> PropertyGraph:
    """Upserts attributes on all objects that meet the condition."""
    frame = getattr(g, on)
    return replace(g, **{on: _changed(frame, where, "attrs", upserted(F.col("attrs"), literals(attrs)))})


def remove_attributes(g: PropertyGraph, where: Column, keys: list[str], on: str = "vertices") -> PropertyGraph:
    low = [k.lower() for k in keys]
    frame = getattr(g, on)
    # The lambda, which is not compiled, only sees the maps that hold one of the keys.
    held = reduce(Column.__or__, [F.map_contains_key("attrs", k) for k in low], F.lit(False))
    return replace(g, **{on: _changed(frame, F.coalesce(where, F.lit(False)) & held, "attrs", F.map_filter("attrs", lambda k, _: ~k.isin(low)))})


def set_type(g: PropertyGraph, where: Column, type_id: str | None) -> PropertyGraph:
    """Attaches vertices to a type, or detaches them (None)."""
    return replace(g, vertices=_changed(g.vertices, where, "type_id", F.lit(type_id).cast("string")))


def clear_type(g: PropertyGraph, type_id: str) -> PropertyGraph:
    """Detaches all vertices of a type."""
    return set_type(g, F.col("type_id") == type_id, None)


def rename_type(g: PropertyGraph, name: str, new: str) -> PropertyGraph:
    """Renames a type; a name that another type has is an error."""
    if new != name and not g.types.where(F.col("name") == new).isEmpty():
        raise ValueError(f"there is a type {new!r} already")
    return replace(g, types=_changed(g.types, F.col("name") == name, "name", F.lit(new)))


def rename_attribute(g: PropertyGraph, type_id: str, old: str, new: str) -> PropertyGraph:
    """Renames an attribute in a type's template and on all its vertices. Validate first: no key may be taken."""
    old, new = old.lower(), new.lower()
    swap = lambda m: F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(F.when(e["key"] == old, F.lit(new)).otherwise(e["key"]).alias("key"), e["value"].alias("value"))))
    types = g.types.withColumn("attr_order", F.when(F.col("id") == type_id, F.transform("attr_order", lambda a: F.when(a == old, F.lit(new)).otherwise(a))).otherwise(F.col("attr_order")))
    types = _changed(types, F.col("id") == type_id, "attrs", swap("attrs"))
    return replace(g, types=types, vertices=_changed(g.vertices, F.col("type_id") == type_id, "attrs", swap("attrs")))


def connect(g: PropertyGraph, sources: DataFrame, targets: DataFrame, attrs: dict[str, Any], both: bool = False) -> PropertyGraph:
    """Adds an edge from every source to every target, and back if both: a product by its meaning, however large."""
    pairs = sources.select(F.col("id").alias("src")).crossJoin(targets.select(F.col("id").alias("dst")))
    if both:
        pairs = pairs.withColumn("_e", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).select("_e.src", "_e.dst")
    new = pairs.select(F.lit(None).cast("string").alias("id"), "src", "dst", literals(attrs).alias("attrs"))
    return replace(g, edges=appended(g.edges, _numbered(new, g.edges, EDGE)))
