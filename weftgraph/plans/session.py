"""Running statements on a graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import EXISTS, MapAccess
from ..model import GraphView, PropertyGraph, VertexPattern, type_rows, vertex_rows
from ..operators import mutate, pattern, select
from ..sources import storage
from ..streaming.changelog import ChangeLog, change_rows
from . import parser, scratch
from . import syntax as S
from .parser import ATTRIBUTE_TAKEN, LACKS_ATTRIBUTE, MERGE_MISMATCH, NO_EDGE, NO_TYPE, NO_VERTEX, NO_VERTICES, GraphQueryError


Changed = tuple[PropertyGraph, list[tuple[str, str, DataFrame]]]


@dataclass(frozen=True)
class Result:
    """kind: vertex, edge, type or change; frame: what a select found (ids of vertices, src and dst of edges, types)."""

    kind: str
    frame: DataFrame | None = None


class Session:
    """Holds a graph and runs statements on it; changes replace the graph and are written after some of them.

    strict: a select that finds no vertices is error 7; else it gives an empty frame. star_as_path: the hops after a leading
    variable form one path instead of starting from the variable each. log: a ChangeLog that gets what every statement changes.
    path: where the graph is stored; autosave: save there after every statement that changes it.
    """

    def __init__(self, graph: GraphView, *, strict: bool = True, star_as_path: bool = False, write_after: int = 8, log: ChangeLog | None = None, path: str | None = None, autosave: bool = False):
        if autosave and path is None:
            raise ValueError("autosave needs a path")
        self.graph, self.strict, self.star_as_path, self.write_after = graph, strict, star_as_path, write_after
        self.log, self.path, self.autosave = log, path, autosave
        self._changes = self._number = 0
        self._settled = graph if isinstance(graph, PropertyGraph) else None  # the tables as they were given or written last
        self._version = log.last_version() if log else 0
        self._subscribers: list[Callable[[DataFrame, int], None]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Session:
        """A session on the graph stored at path; save() goes back there."""
        return cls(storage.load(spark, path), path=path, **options)

    def save(self, path: str | None = None) -> None:
        """Saves the graph where it was opened or saved last, or at another path, which then is its place."""
        path = path or self.path
        if path is None:
            raise ValueError("the graph has no path yet")
        if not isinstance(self.graph, PropertyGraph):
            raise TypeError("only a graph in the map layout can be saved; see WideGraph.to_map_layout()")
        storage.save(self.graph, path, mode="overwrite")
        self.path, self.graph = path, storage.load(self.graph.spark, path)
        self._settled = self.graph

    def subscribe(self, subscriber: Callable[[DataFrame, int], None]) -> None:
        """Calls subscriber(changes, version) after every statement that changes the graph; changes as in a change log."""
        self._subscribers.append(subscriber)

    def execute(self, text: str) -> list[Result]:
        """Runs statement after statement; the first error stops, and what ran before it stays."""
        out = []
        for self._number, statement in enumerate(parser.Parser(text).statements()):
            out.append(self.run(statement))
        return out

    def query(self, text: str) -> DataFrame:
        """The result of the last statement, a select."""
        return self.execute(text)[-1].frame

    def run(self, statement) -> Result:
        if isinstance(statement, (S.SelectTypes, S.SelectEdges, S.SelectVertices, S.MatchPath, S.MatchStar)):
            return self._select(statement)
        if not isinstance(self.graph, PropertyGraph):
            raise TypeError("only a graph in the map layout can be changed; see WideGraph.to_map_layout()")
        old = self.graph
        changed, parts = getattr(self, "_" + type(statement).__name__)(statement)
        self._changes += 1
        if self._changes % self.write_after == 0:
            changed = self._settled = self._written(changed)
        if self.log or self._subscribers:
            self._version += 1
            rows = scratch.written(change_rows(old.spark, parts, self._version))
            if self.log:
                self.log.write(rows)
            for subscriber in self._subscribers:
                subscriber(rows, self._version)
        self.graph = changed
        if self.autosave:
            self.save()
        return Result("change")

    def _written(self, g: PropertyGraph) -> PropertyGraph:
        """g with its tables written. What statements have left alone since, or only added written rows to, is not written again."""

        def settled(frame: DataFrame, before: DataFrame) -> bool:
            own, known = scratch.parts(frame), scratch.parts(before)
            return len(own) <= scratch.MOST_PARTS and all(scratch.is_written(x) or any(x is y for y in known) for x in own)

        tables = {n: (getattr(g, n), getattr(self._settled, n)) for n in ("vertices", "edges", "types")}
        return replace(g, **{n: scratch.written(frame) for n, (frame, before) in tables.items() if not settled(frame, before)})

    def _error(self, code: int, token: str) -> GraphQueryError:
        return GraphQueryError(code, self._number, token)

    # Selects.

    def _known(self, p: VertexPattern) -> None:
        if p.type is None:
            return
        if isinstance(self.graph, PropertyGraph):
            self._type(p.type)
        elif not self.graph.vertex_sets(p.type):
            raise self._error(NO_TYPE, p.type)

    def _select(self, s) -> Result:
        g = self.graph
        if isinstance(s, S.SelectTypes):
            if isinstance(g, PropertyGraph):
                return Result("type", select.type_by_name(g, s.name) if s.name is not None else select.types_with_attributes(g, list(s.keys)))
            names = [n for n, t in g.vertex_tables.items() if (n == s.name if s.name is not None else {k.lower() for k in s.keys} <= {a.lower() for a in t.attributes})]
            return Result("type", g.spark.createDataFrame([(n,) for n in names], "name string"))
        if isinstance(s, S.SelectEdges):
            self._known(s.source)
            self._known(s.target)
            return Result("edge", pattern.edges_between(g, s.source, s.target, s.conditions))
        if isinstance(s, S.SelectVertices):
            self._known(s.pattern)
            frame = select.select_matching(g, s.pattern)
        elif isinstance(s, S.MatchPath):
            for p in (s.start, *(h.to for h in s.hops)):
                self._known(p)
            frame = pattern.match_path(g, s.start, list(s.hops))
        else:
            for p in (s.subject, *(h.to for h in s.hops)):
                self._known(p)
            frame = (pattern.match_chain if self.star_as_path else pattern.match_star)(g, s.subject, list(s.hops))
        if self.strict:
            frame = scratch.written(frame)  # so that looking whether there is a row does not run the match a second time
            if frame.isEmpty():
                raise self._error(NO_VERTICES, "the pattern")
        return Result("vertex", frame)

    # Changes.

    def _type(self, name: str):
        row = self.graph.types.where(F.col("name") == name).first()
        if row is None:
            raise self._error(NO_TYPE, name)
        return row

    def _where(self, ref: S.Ref) -> Column:
        return MapAccess().equals(ref.key, ref.value)

    def _found(self, ref: S.Ref) -> DataFrame:
        frame = self.graph.vertices.where(self._where(ref))
        if frame.isEmpty():
            raise self._error(NO_VERTEX, ref.key)
        return frame

    def _bound(self, kind: str, positional: tuple, attrs: dict):
        row = self._type(kind)
        if len(positional) > len(row.attr_order):
            raise self._error(LACKS_ATTRIBUTE, str(positional[len(row.attr_order)]))
        return row.id, dict(zip(row.attr_order, positional, strict=False)) | attrs

    # Each of these gives the changed graph, and (kind, operation, rows) of what it changes: rows as they are after the change,
    # or as they were before their removal. All are plans that run only if something listens.

    def _CreateVertex(self, s: S.CreateVertex) -> Changed:
        type_id, attrs = self._bound(s.type, s.positional, s.attrs) if s.type is not None else (None, s.attrs)
        rows = vertex_rows(self.graph.spark, [(str(uuid.uuid4()), type_id, attrs)])
        return mutate.add_vertices(self.graph, rows)[0], [("vertex", "add", rows)]

    def _CreateEdge(self, s: S.CreateEdge) -> Changed:
        vertices = self.graph.vertices
        g = mutate.connect(self.graph, vertices.where(self._where(s.source)), vertices.where(self._where(s.target)), s.attrs, s.both)
        return g, [("edge", "add", scratch.parts(g.edges)[-1])]

    def _CreateType(self, s: S.CreateType) -> Changed:
        rows = type_rows(self.graph.spark, [(str(uuid.uuid4()), s.name, list(s.keys))])
        g, rejected = mutate.add_types(self.graph, rows)
        return g, [("type", "add", rows.join(rejected.select("id"), "id", "left_anti"))]

    def _ChangeVertex(self, s: S.ChangeVertex) -> Changed:
        where = self._where(s.at)
        if s.strict:
            found = self._found(s.at)
            for key in s.attrs:
                if not found.where(~MapAccess().has(key)).isEmpty():
                    raise self._error(MERGE_MISMATCH, key)
        attrs, type_id = s.attrs, None
        if s.type is not None:
            type_id, attrs = self._bound(s.type, s.positional, attrs)

        def change(vertices: DataFrame) -> DataFrame:
            # Both changes in one pass over the old rows: the second must not see the first's values.
            g = replace(self.graph, vertices=vertices.withColumn("_hit", where))
            if s.type is not None:
                g = mutate.set_type(g, F.col("_hit"), type_id)
            return mutate.set_attributes(g, F.col("_hit"), attrs).vertices.drop("_hit")

        return replace(self.graph, vertices=change(self.graph.vertices)), [("vertex", "change", change(self.graph.vertices.where(where)))]

    def _DropAttributes(self, s: S.DropAttributes) -> Changed:
        found, where = self._found(s.at), self._where(s.at)
        after = mutate.remove_attributes(replace(self.graph, vertices=found), F.lit(True), list(s.keys)).vertices
        return mutate.remove_attributes(self.graph, where, list(s.keys)), [("vertex", "change", after)]

    def _DeleteVertex(self, s: S.DeleteVertex) -> Changed:
        if s.at is not None:
            found = self._found(s.at)
        else:
            found = select.by_id(self.graph.vertices, s.id)
            if found.isEmpty():
                raise self._error(NO_VERTEX, s.id)
        g, lost = mutate.remove_vertices(self.graph, found)[0], mutate.edges_at(self.graph.edges, found)
        if lost.isEmpty():
            g = replace(g, edges=self.graph.edges)  # the same table, which need not be written again
        return g, [("vertex", "remove", found), ("edge", "remove", lost)]

    def _DeleteType(self, s: S.DeleteType) -> Changed:
        if s.name is not None:
            self._type(s.name)
            found = select.type_by_name(self.graph, s.name)
        else:
            found = select.by_id(self.graph.types, s.id)
            if found.isEmpty():
                raise self._error(NO_TYPE, s.id)
        freed = self.graph.vertices.join(found.select(F.col("id").alias("type_id")), "type_id", "left_semi").withColumn("type_id", F.lit(None).cast("string"))
        return mutate.remove_types(self.graph, found)[0], [("type", "remove", found), ("vertex", "change", freed)]

    def _DeleteEdge(self, s: S.DeleteEdge) -> Changed:
        access = MapAccess()
        labelled = F.lit(False)
        for key in s.keys:
            labelled = labelled | access.has(key)
        found = self.graph.edges.where(labelled)
        for end, ref in (("src", s.source), ("dst", s.target)):
            ids = self._found(ref).select(F.col("id").alias("_v"))
            found = found.join(ids, F.col(end) == F.col("_v"), "left_semi")
        if found.isEmpty():
            raise self._error(NO_EDGE, ", ".join(s.keys))
        # Edges without such a key stay where they lie; only the others are looked up by id.
        kept = mutate.remove_edges(replace(self.graph, edges=self.graph.edges.where(labelled)), found)[0].edges
        return replace(self.graph, edges=kept.unionByName(self.graph.edges.where(~labelled))), [("edge", "remove", found)]

    def _ChangeType(self, s: S.ChangeType) -> Changed:
        row, g = self._type(s.name), self.graph
        keys = list(row.attr_order)
        for old, new in s.renamed:
            if old.lower() not in keys:
                raise self._error(LACKS_ATTRIBUTE, old)
            members = g.vertices.where(F.col("type_id") == row.id)
            if new.lower() in keys or not members.where(MapAccess().has(new)).isEmpty():
                raise self._error(ATTRIBUTE_TAKEN, new)
            g = mutate.rename_attribute(g, row.id, old, new)
            keys[keys.index(old.lower())] = new.lower()
        if s.new_name is not None:
            if s.new_name != s.name and not g.types.where(F.col("name") == s.new_name).isEmpty():
                raise self._error(ATTRIBUTE_TAKEN, s.new_name)
            g = mutate.rename_type(g, s.name, s.new_name)
        parts = [("type", "change", select.by_id(g.types, row.id))]
        if s.renamed:
            parts.append(("vertex", "change", g.vertices.where(F.col("type_id") == row.id)))
        return g, parts


__all__ = ["EXISTS", "GraphQueryError", "Result", "Session"]
