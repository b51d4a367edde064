"""Selections, lookups, degrees and projections."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import EXISTS, MapAccess
from ..model import GraphView, PropertyGraph, VertexPattern, union
from ..plans.scratch import written
from .mutate import few

Where = Callable[[MapAccess], Column] | Column | None


class NotSingleError(ValueError):
    """A lookup that must find at most one object found several."""


def _select(frame: DataFrame, key: str | None, value: Any, where: Where, within: DataFrame | None, order_by: str | None) -> DataFrame:
    access = MapAccess()
    if key is not None:
        frame = frame.where(access.equals(key, value))
    if where is not None:
        frame = frame.where(where(access) if callable(where) else where)
    if within is not None:
        frame = frame.join(within.select("id"), "id", "left_semi")
    return frame.orderBy(*access.order(order_by), "seq") if order_by else frame


def select_vertices(g: PropertyGraph, key: str | None = None, value: Any = EXISTS, *, type: str | None = None, where: Where = None, within: DataFrame | None = None, order_by: str | None = None) -> DataFrame:
    """Vertices that have key (and value, if given), of a type, meeting a condition, out of a set; sorted on demand."""
    return _select(g.vertex_sets(type)[0].frame.drop("k"), key, value, where, within, order_by)


def select_edges(g: PropertyGraph, key: str | None = None, value: Any = EXISTS, *, src: str | None = None, dst: str | None = None, where: Where = None, within: DataFrame | None = None, order_by: str | None = None) -> DataFrame:
    """Edges by key and value, endpoints, condition and set."""
    frame = g.edges
    if src is not None:
        frame = frame.where(F.col("src") == src)
    if dst is not None:
        frame = frame.where(F.col("dst") == dst)
    return _select(frame, key, value, where, within, order_by)


def select_types(g: PropertyGraph, key: str | None = None, value: Any = EXISTS, *, where: Where = None, within: DataFrame | None = None, order_by: str | None = None) -> DataFrame:
    return _select(g.types, key, value, where, within, order_by)


def types_with_attributes(g: PropertyGraph, keys: list[str]) -> DataFrame:
    """Types whose template has all the keys."""
    frame = g.types
    for k in keys:
        frame = frame.where(MapAccess().has(k))
    return frame


def type_by_name(g: PropertyGraph, name: str) -> DataFrame:
    return g.types.where(F.col("name") == name)


def by_id(frame: DataFrame, id: str) -> DataFrame:
    return frame.where(F.col("id") == id)


def single(frame: DataFrame):
    """The only row, or None; several rows are an error."""
    rows = frame.limit(2).collect()
    if len(rows) > 1:
        raise NotSingleError("several objects match")
    return rows[0] if rows else None


def parallel_edges(g: PropertyGraph, src: str, dst: str, *, within: DataFrame | None = None, order_by: str | None = None) -> DataFrame:
    """All edges from src to dst."""
    return select_edges(g, src=src, dst=dst, within=within, order_by=order_by)


def parallel_pairs(g: GraphView, label: str | None = None) -> DataFrame:
    """(src, dst, n) of endpoints with several edges between them."""
    parts = [e.frame.groupBy("s", "d").agg(F.count("*").alias("n")).where("n > 1").select(e.src_id.alias("src"), e.dst_id.alias("dst"), "n") for e in g.edge_sets(label)]
    return union(parts)


def incident_edges(g: PropertyGraph, id: str, direction: str = "both") -> DataFrame:
    """Edges out of, into, or at a vertex; a self-loop counts once here."""
    out, into = F.col("src") == id, F.col("dst") == id
    return g.edges.where({"out": out, "in": into, "both": out | into}[direction])


def degrees(g: GraphView, type: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """(id, in_degree, out_degree, degree) of every vertex; a self-loop counts twice in degree."""
    edges = [e for label in (labels or [None]) for e in g.edge_sets(label)]
    parts = []
    for v in g.vertex_sets(type):
        outs = [e.frame.select(F.col("s").alias("k")) for e in edges if e.src_type == v.type]
        ins = [e.frame.select(F.col("d").alias("k")) for e in edges if e.dst_type == v.type]
        frame = v.frame.select("k", v.id.alias("id"))
        for side, name in ((ins, "in_degree"), (outs, "out_degree")):
            if side:
                counted = union(side).groupBy("k").agg(F.count("*").alias(name))
                frame = frame.join(counted, "k", "left")
            else:
                frame = frame.withColumn(name, F.lit(0))
        i, o = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("in_degree", "out_degree"))
        parts.append(frame.select("id", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("degree")))
    return union(parts)


def type_counts(g: GraphView) -> DataFrame:
    """(type_name, n) of the vertices of each type."""
    if isinstance(g, PropertyGraph):
        named = g.vertices.groupBy("type_id").agg(F.count("*").alias("n")).join(g.types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name")), "type_id", "left")
        return named.groupBy("type_name").agg(F.sum("n").alias("n"))
    return union([v.frame.agg(F.count("*").alias("n")).select(F.lit(v.type).alias("type_name"), "n") for v in g.vertex_sets()])


def select_matching(g: GraphView, pattern: VertexPattern, where: Callable | None = None) -> DataFrame:
    """(id) of the vertices of a pattern, over both layouts; where: a condition on the attributes' access."""
    parts = []
    for v in g.matching(pattern):
        frame = v.frame.where(where(v.access)) if where else v.frame
        parts.append(frame.select(v.id.alias("id")))
    return union(parts) if parts else g.spark.createDataFrame([], "id string")


def ranked(frame: DataFrame, access, key: str, tie: str) -> DataFrame:
    """frame with rk: the place in ascending order of an attribute, nulls first. For the sorted order as a column.

    Rows are dealt to tasks by ranges of the order and sorted there; the places before a range are the sizes of the ranges
    before it, of which the driver holds one number for each task.
    """
    order = [*access.order(key), tie]
    ranged = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged)
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for p, n in sorted(map(tuple, ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())):
        before[p] = total
        total += n
    starts = frame.sparkSession.createDataFrame(sorted(before.items()), "_part bigint, _start bigint")
    placed = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part")  # a row for each task
    return placed.withColumn("rk", F.col("_start") + inside + 1).drop("_part", "_start", "_at")


def _text(value: Column) -> Column:
    return F.coalesce(value["s"], value["i"].cast("string"), value["d"].cast("string"), value["b"].cast("string"))


def attributes_as_text(attrs: Column) -> Column:
    """Attributes as text, by key: 'key : value' lines, 'key*' for keys without a value."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(attrs)), lambda e: F.when(e["value"].isNull(), F.concat(e["key"], F.lit("* \n"))).otherwise(F.concat(e["key"], F.lit(" : "), _text(e["value"]), F.lit(" \n")))), "")


def vertices_as_text(g: PropertyGraph) -> DataFrame:
    """(id, text): the attributes, the type's name and the degrees of every vertex."""
    names = g.types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    full = g.vertices.join(names, "type_id", "left").join(degrees(g), "id")
    text = F.concat(attributes_as_text(F.col("attrs")), F.concat(F.lit("Type : "), F.coalesce("type_name", F.lit("")), F.lit(" \nInDegree : "), "in_degree", F.lit(" \nOutDegree : "), "out_degree", F.lit(" \n")))
    return full.select("id", text.alias("text"))


def edges_as_text(g: PropertyGraph, within: DataFrame | None = None) -> DataFrame:
    """(id, text): the endpoints and attributes of every edge, or of those of a set (id)."""
    edges = g.edges if within is None else g.edges.join(few(within.select("id")), "id", "left_semi")
    return edges.select("id", F.concat(F.lit("Source : "), "src", F.lit(" \nTarget : "), "dst", F.lit(" \n"), attributes_as_text(F.col("attrs"))).alias("text"))
