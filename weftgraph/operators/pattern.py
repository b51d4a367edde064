"""Patterns: edges between vertex sets, paths, stars and any-edge hops, as chains of semi-joins.

A vertex set is always the left side of a semi-join, and its keys are unique, so hops need no distinct. Edge sets whose
endpoint types do not fit are not read at all. Where several types are met between two hops, their keys are written there: else
every target's plan would hold the plans of all sources again, hop by hop.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import compares
from ..model import EdgeSet, GraphView, VertexPattern, VertexSet, union
from ..plans.scratch import written


@dataclass(frozen=True)
class Condition:
    key: str
    op: str  # one of = > < >= <=
    value: float


@dataclass(frozen=True)
class Hop:
    label: str | None  # None: any edge
    to: VertexPattern


def _conditioned(e: EdgeSet, conditions: tuple[Condition, ...]) -> DataFrame:
    frame = e.frame
    for c in conditions:
        frame = frame.where(compares(e.access, c.key, c.op, c.value))
    return frame


def _reached(g: GraphView, sources: list[VertexSet], label: str | None, targets: list[VertexSet]) -> list[VertexSet]:
    """The targets that an edge with the label reaches from a source."""
    out = []
    for t in targets:
        ends = [
            e.frame.join(s.frame.select(F.col("k").alias("sk")), F.col("s") == F.col("sk"), "left_semi").select("d")
            for e in g.edge_sets(label)
            for s in sources
            if e.dst_type == t.type and e.src_type == s.type
        ]
        if ends:
            out.append(VertexSet(t.type, t.frame.join(union(ends), F.col("k") == F.col("d"), "left_semi"), t.access, t.id))
    return out


def _ids(g: GraphView, sets: list[VertexSet]) -> DataFrame:
    return union([v.frame.select(v.id.alias("id")) for v in sets]) if sets else g.spark.createDataFrame([], "id string")


def match_path(g: GraphView, start: VertexPattern, hops: list[Hop]) -> DataFrame:
    """(id) of the vertices at the end of a path: start, then hop by hop. Each vertex comes once."""
    sets = g.matching(start)
    for i, hop in enumerate(hops):
        sets = _reached(g, sets, hop.label, g.matching(hop.to))
        if i + 1 < len(hops):
            sets = _held(sets)
    return _ids(g, sets)


def _held(sets: list[VertexSet]) -> list[VertexSet]:
    """The same keys; written if there are several sets, or one of many types, so that each is worked out once and plans stay short."""
    return [replace(v, frame=written(v.frame.select("k"))) for v in sets] if len(sets) > 1 or any(v.type is None for v in sets) else sets


def match_star(g: GraphView, subject: VertexPattern, hops: list[Hop]) -> DataFrame:
    """(id) of the subjects from which every hop, each taken from the subject itself, finds a vertex."""
    sets = g.matching(subject)
    for i, hop in enumerate(hops):
        kept = []
        ends = g.matching(hop.to)
        for v in sets:
            starts = [
                e.frame.join(t.frame.select(F.col("k").alias("tk")), F.col("d") == F.col("tk"), "left_semi").select("s")
                for e in g.edge_sets(hop.label)
                for t in ends
                if e.src_type == v.type and e.dst_type == t.type
            ]
            if starts:
                kept.append(VertexSet(v.type, v.frame.join(union(starts), F.col("k") == F.col("s"), "left_semi"), v.access, v.id))
        sets = _held(kept) if i + 1 < len(hops) else kept
    return _ids(g, sets)


def match_chain(g: GraphView, subject: VertexPattern, hops: list[Hop]) -> DataFrame:
    """(id) of the subjects from which the hops form one path. Semi-joins run from the far end back to the subject."""
    patterns = [subject, *(h.to for h in hops)]
    sets = g.matching(patterns[-1])
    for i in range(len(hops) - 1, -1, -1):
        back = []
        for v in g.matching(patterns[i]):
            starts = [
                e.frame.join(t.frame.select(F.col("k").alias("tk")), F.col("d") == F.col("tk"), "left_semi").select("s")
                for e in g.edge_sets(hops[i].label)
                for t in sets
                if e.src_type == v.type and e.dst_type == t.type
            ]
            if starts:
                back.append(VertexSet(v.type, v.frame.join(union(starts), F.col("k") == F.col("s"), "left_semi"), v.access, v.id))
        sets = _held(back) if i else back
    return _ids(g, sets)


def edge_frames_between(g: GraphView, src: VertexPattern, dst: VertexPattern, conditions: tuple[Condition, ...] = (), label: str | None = None) -> list[EdgeSet]:
    """The edges from one vertex set to another that meet all numeric conditions, with all their columns."""
    out = []
    sources, targets = g.matching(src), g.matching(dst)
    for e in g.edge_sets(label):
        for s in sources:
            for t in targets:
                if e.src_type == s.type and e.dst_type == t.type:
                    frame = _conditioned(e, conditions)
                    frame = frame.join(s.frame.select(F.col("k").alias("sk")), F.col("s") == F.col("sk"), "left_semi")
                    frame = frame.join(t.frame.select(F.col("k").alias("tk")), F.col("d") == F.col("tk"), "left_semi")
                    out.append(EdgeSet(e.src_type, e.dst_type, frame, e.access, e.src_id, e.dst_id))
    return out


def edges_between(g: GraphView, src: VertexPattern, dst: VertexPattern, conditions: tuple[Condition, ...] = (), label: str | None = None) -> DataFrame:
    """(src, dst) of the edges between two vertex sets, one row for each edge."""
    parts = [e.frame.select(e.src_id.alias("src"), e.dst_id.alias("dst")) for e in edge_frames_between(g, src, dst, conditions, label)]
    return union(parts) if parts else g.spark.createDataFrame([], "src string, dst string")
