"""The two layouts of a property graph, behind one view that selections and patterns are written against."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.attributes import ATTR, ATTRS, EXISTS, Access, ColumnAccess, MapAccess, tagged

VERTEX = f"seq bigint, id string, type_id string, attrs {ATTRS}"
EDGE = f"seq bigint, id string, src string, dst string, attrs {ATTRS}"
TYPE = f"seq bigint, id string, name string, attr_order array<string>, attrs {ATTRS}"


@dataclass(frozen=True)
class VertexPattern:
    """Vertices of a type (None: any) whose attributes meet all of (key, value); EXISTS as a value asks for the key alone."""

    type: str | None = None
    where: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class VertexSet:
    """Vertices of one type, as a frame with a unique key column k, with access to their attributes."""

    type: str | None
    frame: DataFrame
    access: Access
    id: Column  # the graph-wide id, of the frame's columns


@dataclass(frozen=True)
class EdgeSet:
    """Edges of one kind, as a frame with endpoint key columns s and d."""

    src_type: str | None
    dst_type: str | None
    frame: DataFrame
    access: Access
    src_id: Column
    dst_id: Column


class GraphView:
    """What selections need of a graph: vertex sets by type, edge sets by label."""

    def vertex_sets(self, type_name: str | None = None) -> list[VertexSet]:
        raise NotImplementedError

    def edge_sets(self, label: str | None = None) -> list[EdgeSet]:
        raise NotImplementedError

    def matching(self, pattern: VertexPattern) -> list[VertexSet]:
        """The vertex sets of a pattern, filtered."""
        out = []
        for v in self.vertex_sets(pattern.type):
            frame = v.frame
            for key, value in pattern.where:
                frame = frame.where(v.access.equals(key, value))
            out.append(replace(v, frame=frame))
        return out


@dataclass(frozen=True)
class PropertyGraph(GraphView):
    """The map layout: three tables, schemaless attributes. Immutable; changes give a new graph."""

    vertices: DataFrame
    edges: DataFrame
    types: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    is_directed = True

    def vertex_sets(self, type_name: str | None = None) -> list[VertexSet]:
        frame = self.vertices
        if type_name is not None:
            ids = self.types.where(F.col("name") == type_name).select(F.col("id").alias("type_id"))
            frame = frame.join(F.broadcast(ids.limit(1)), "type_id", "left_semi")  # names are unique: one row
        return [VertexSet(None, frame.withColumn("k", F.col("id")), MapAccess(), F.col("k"))]

    def edge_sets(self, label: str | None = None) -> list[EdgeSet]:
        access = MapAccess()
        frame = self.edges if label is None else self.edges.where(access.has(label))
        return [EdgeSet(None, None, frame.withColumns({"s": F.col("src"), "d": F.col("dst")}), access, F.col("s"), F.col("d"))]

    def counts(self) -> dict[str, int]:
        return {"vertices": self.vertices.count(), "edges": self.edges.count(), "types": self.types.count()}


def vertex_rows(spark: SparkSession, rows: list[tuple[str, str | None, dict[str, Any]]], start: int = 0) -> DataFrame:
    """Vertices from (id, type_id, attributes)."""
    return spark.createDataFrame([(start + i, x, t, {k.lower(): tagged(v) for k, v in a.items()}) for i, (x, t, a) in enumerate(rows)], VERTEX)


def edge_rows(spark: SparkSession, rows: list[tuple[str, str, str, dict[str, Any]]], start: int = 0) -> DataFrame:
    """Edges from (id, src, dst, attributes); both endpoints must be given."""
    if any(s is None or d is None for _, s, d, _ in rows):
        raise ValueError("an edge has two endpoints")
    return spark.createDataFrame([(start + i, x, s, d, {k.lower(): tagged(v) for k, v in a.items()}) for i, (x, s, d, a) in enumerate(rows)], EDGE)


def type_rows(spark: SparkSession, rows: list[tuple[str, str, list[str]]], start: int = 0) -> DataFrame:
    """Types from (id, name, template attributes in order)."""
    return spark.createDataFrame([(start + i, x, n, [a.lower() for a in attrs], {a.lower(): None for a in attrs}) for i, (x, n, attrs) in enumerate(rows)], TYPE)


def empty_graph(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph(vertex_rows(spark, []), edge_rows(spark, []), type_rows(spark, []))


@dataclass(frozen=True)
class VertexTable:
    """A table of vertices of one type: key column, id prefix, attribute columns."""

    frame: DataFrame
    key: str
    prefix: str
    attributes: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeTable:
    """A table of edges of one label between two types. attributes: names to columns; the label is always present."""

    frame: DataFrame
    src_type: str
    src: str
    dst_type: str
    dst: str
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class WideGraph(GraphView):
    """The wide layout: a table for each vertex type and edge label, so that filters and columns reach the scans.

    Joins go by the tables' own keys; prefixed ids are made only for results.
    """

    vertex_tables: dict[str, VertexTable]
    edge_tables: dict[str, list[EdgeTable]]

    @property
    def spark(self) -> SparkSession:
        return next(iter(self.vertex_tables.values())).frame.sparkSession

    def vertex_sets(self, type_name: str | None = None) -> list[VertexSet]:
        out = []
        for name, t in self.vertex_tables.items():
            if type_name in (None, name):
                access = ColumnAccess(t.frame, {a: a for a in t.attributes})
                out.append(VertexSet(name, t.frame.withColumn("k", F.col(t.key)), access, self.id_of(name, F.col("k"))))
        return out

    def edge_sets(self, label: str | None = None) -> list[EdgeSet]:
        out = []
        for name, tables in self.edge_tables.items():
            if label is None or name.lower() == label.lower():
                for t in tables:
                    frame = t.frame.withColumns({"s": F.col(t.src), "d": F.col(t.dst)})
                    out.append(EdgeSet(t.src_type, t.dst_type, frame, ColumnAccess(t.frame, t.attributes), self.id_of(t.src_type, F.col("s")), self.id_of(t.dst_type, F.col("d"))))
        return out

    def id_of(self, type_name: str, key: Column) -> Column:
        return F.concat(F.lit(self.vertex_tables[type_name].prefix), key.cast("string"))

    def to_map_layout(self) -> PropertyGraph:
        """The same graph in the map layout, with type names as type ids.

        A row's place in its Parquet file is its sequence number, and a hash of its file and the place make an edge's id, which
        compresses well; where rows come from elsewhere, a hash of all their columns stands for both.
        """

        def place(frame: DataFrame, *of: str) -> tuple[Column, Column]:
            """(sequence number, id of an edge of that label and source)."""
            try:
                frame.select("_metadata.row_index", "_metadata.file_name").schema  # noqa: B018
            except AnalysisException:
                own = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in frame.columns])
                return F.xxhash64(own), F.sha2(F.concat_ws("|", *map(F.lit, of), own), 256)
            return F.col("_metadata.row_index"), F.concat_ws("-", F.hex(F.xxhash64(*map(F.lit, of), "_metadata.file_name")), "_metadata.row_index")

        def attrs(frame: DataFrame, columns: dict[str, str], label: str | None = None) -> Column:
            """The attribute map. All of it is compiled: a lambda over entries costs microseconds a row.

            Where all columns have values the map is made in one piece, else of a piece for each column.
            """
            kinds = dict(frame.dtypes)
            entries = []
            for name, c in columns.items():
                kind = {"string": "string", "double": "double", "float": "double", "boolean": "bool"}.get(kinds[c], "int" if "int" in kinds[c] else "string")
                text = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kinds[c] == "timestamp" else F.col(c).cast("string")
                value = F.struct(
                    F.lit(kind).alias("t"),
                    (text if kind == "string" else F.lit(None).cast("string")).alias("s"),
                    (F.col(c).cast("bigint") if kind == "int" else F.lit(None).cast("bigint")).alias("i"),
                    (F.col(c).cast("double") if kind == "double" else F.lit(None).cast("double")).alias("d"),
                    (F.col(c) if kind == "bool" else F.lit(None).cast("boolean")).alias("b"),
                )
                entries.append((F.col(c).isNotNull(), F.lit(name.lower()), value))
            bare = [F.lit(label.lower()), F.lit(None).cast(ATTR)] if label is not None else []
            if not entries:
                return F.create_map(*bare) if bare else F.expr(f"cast(map() as {ATTRS})")
            whole = F.create_map(*bare, *[x for _, k, v in entries for x in (k, v)])
            empty = F.expr(f"cast(map() as {ATTRS})")
            pieces = [F.when(there, F.create_map(k, v)).otherwise(empty) for there, k, v in entries]
            return F.when(reduce(Column.__and__, [there for there, _, _ in entries]), whole).otherwise(F.map_concat(*([F.create_map(*bare)] if bare else []), *pieces))

        vertices = [
            v.frame.select(place(v.frame)[0].cast("bigint").alias("seq"), v.id.alias("id"), F.lit(v.type).alias("type_id"), attrs(v.frame, {a: a for a in self.vertex_tables[v.type].attributes}).alias("attrs"))
            for v in self.vertex_sets()
        ]
        edges = []
        for label, tables in self.edge_tables.items():
            for t in tables:
                frame = t.frame.withColumns({"s": F.col(t.src), "d": F.col(t.dst)})
                own = attrs(frame, t.attributes, None if label.lower() in {a.lower() for a in t.attributes} else label)
                seq, row_id = place(t.frame, label, t.src_type)
                edges.append(frame.select(seq.cast("bigint").alias("seq"), row_id.alias("id"), self.id_of(t.src_type, F.col("s")).alias("src"), self.id_of(t.dst_type, F.col("d")).alias("dst"), own.alias("attrs")))
        types = type_rows(self.spark, [(n, n, list(t.attributes)) for n, t in self.vertex_tables.items()])
        return PropertyGraph(union(vertices), union(edges), types)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


__all__ = ["EXISTS", "EdgeSet", "EdgeTable", "GraphView", "PropertyGraph", "VertexPattern", "VertexSet", "VertexTable", "WideGraph", "edge_rows", "empty_graph", "type_rows", "union", "vertex_rows"]
