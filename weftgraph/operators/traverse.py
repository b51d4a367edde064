"""Breadth-first search and weighted range search, as loops of joins over written frontiers.

Each level is one join of the frontier with the edges and one anti-join with what has been seen; levels are written, so
plans stay short and lost executors cost one level. A frontier that is counted to be small is broadcast, so that the edges are
scanned where they lie; a larger one meets them by a shuffle. The driver sees of a level its size and whether it holds the
target, and the vertices of the one path it returns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import EXISTS, MapAccess
from ..model import PropertyGraph, union
from ..plans.scratch import forget, written

#: Rows of a frontier (ids and a number, some tens of bytes each) up to which it is broadcast.
FRONTIER_ROWS = 200_000
BACK_STEPS = 8


class GraphAlgorithm(Protocol):
    """What can be run on a graph: anything with run(graph) that returns a DataFrame."""

    def run(self, graph: PropertyGraph) -> DataFrame: ...


@dataclass(frozen=True)
class BreadthFirst:
    """bfs_levels() as an algorithm: (v, h, pred) from source over all edges of a graph."""

    source: str
    max_hops: int | None = None

    def run(self, graph: PropertyGraph) -> DataFrame:
        return bfs_levels(graph.edges, self.source, max_hops=self.max_hops)


@dataclass(frozen=True)
class Nearby:
    """search_nearby() as an algorithm."""

    source: str
    within: float
    key: str

    def run(self, graph: PropertyGraph) -> DataFrame:
        return search_nearby(graph, self.source, self.within, self.key)


def run(algorithm: GraphAlgorithm, graph: PropertyGraph) -> DataFrame:
    """Runs an algorithm of this module or of the caller's."""
    return algorithm.run(graph)


def _few(frame: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(frame) if rows <= FRONTIER_ROWS else frame


def _levels(edges: DataFrame, source: str, target: str | None, allowed: DataFrame | None, max_hops: int | None) -> tuple[list[DataFrame], bool]:
    """The levels (v, h, pred), and whether the last one holds the target."""
    spark = edges.sparkSession
    steps = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    if allowed is not None:
        free = allowed.select(F.col("id").alias("dst"))
        kept = steps.join(free, "dst", "left_semi").select("src", "dst")
        steps = kept.unionByName(steps.where(F.col("dst") == target)) if target is not None else kept
    steps = written(steps)
    levels = [written(spark.createDataFrame([(source, 0, None)], "v string, h int, pred string"))]
    seen, n_seen, size, found = levels[0], 1, 1, source == target
    while size and not found and (max_hops is None or len(levels) <= max_hops):
        front = _few(levels[-1].select(F.col("v").alias("src")), size)
        step = steps.join(front, "src").groupBy("dst").agg(F.min("src").alias("pred"))
        new = step.join(_few(seen.select(F.col("v").alias("dst")), n_seen), "dst", "left_anti")
        level = written(new.select(F.col("dst").alias("v"), F.lit(len(levels)).alias("h"), "pred"))
        size, found = level.agg(F.count("*"), F.coalesce(F.max(F.col("v") == target), F.lit(False)) if target is not None else F.lit(False)).first()
        if size:
            levels.append(level)
            n_seen += size
            # Many levels make many small tables; fold them now and then.
            seen = written(union(levels)) if len(levels) % 16 == 0 else seen.unionByName(level)
    forget(steps)
    return levels, found


def bfs_levels(edges: DataFrame, source: str, *, target: str | None = None, allowed: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(v, h, pred) of the vertices that edges (src, dst) reach from source, with the fewest hops.

    pred is the smallest predecessor on the level before. Stops at the target's level. allowed: (id) of the vertices that
    a path may pass through; source and target need not be among them. Parallel edges count once.
    """
    return union(_levels(edges, source, target, allowed, max_hops)[0])


def shortest_path(edges: DataFrame, source: str, target: str, *, allowed: DataFrame | None = None, max_hops: int | None = None, forward: bool = True) -> DataFrame:
    """(step, vertex_id) of a shortest path, from source to target, or from target to source; no rows if there is none."""
    spark = edges.sparkSession
    levels, found = _levels(edges, source, target, allowed, max_hops)
    if not found:
        return spark.createDataFrame([], "step int, vertex_id string")
    path = [target]
    while len(path) < len(levels):
        # Some steps back in one query: each level gives the predecessor that the level after it names.
        at = len(levels) - len(path)
        back = levels[at].where(F.col("v") == path[-1]).select(F.col("pred").alias("p0"))
        n = min(BACK_STEPS, at)
        for i in range(1, n):
            back = back.join(levels[at - i].select(F.col("v").alias("v_"), F.col("pred").alias(f"p{i}")), F.col(f"p{i - 1}") == F.col("v_")).drop("v_")
        path += list(back.first())
    path = path[::-1] if forward else path
    return spark.createDataFrame(list(enumerate(path)), "step int, vertex_id string")


def find_path(g: PropertyGraph, source: str, target: str, *, key: str | None = None, value=EXISTS, where: Column | None = None, on: str = "vertex", forward: bool = True, max_hops: int | None = None) -> DataFrame:
    """A shortest path whose inner vertices (on='vertex') or whose edges (on='edge') have a key, a value or meet a condition."""
    access = MapAccess()
    condition = access.equals(key, value) if key is not None else where
    edges, allowed = g.edges, None
    if condition is not None and on == "edge":
        edges = edges.where(condition)
    elif condition is not None:
        allowed = g.vertices.where(condition).select("id")
    return shortest_path(edges, source, target, allowed=allowed, max_hops=max_hops, forward=forward)


def nearby(edges: DataFrame, source: str, within: float) -> DataFrame:
    """(vertex_id, distance) of the vertices that a walk of at least one edge of total weight up to within reaches.

    edges: (src, dst, w); a null weight counts 1, a negative one is an error. Distances are the least; the source itself
    comes out only through a cycle.
    """
    spark = edges.sparkSession
    steps = edges.select("src", "dst", F.coalesce(F.col("w").cast("double"), F.lit(1.0)).alias("w"))
    if (steps.agg(F.min("w")).first()[0] or 0) < 0:
        raise ValueError("weights must not be negative")
    steps = written(steps.where(F.col("w") <= within))
    rounds: list[DataFrame] = []  # (v, dist): each round's betterings; a later one of a vertex is smaller
    known, n_known = spark.createDataFrame([], "v string, dist double"), 0
    frontier, size = spark.createDataFrame([(source, 0.0)], "v string, dist double"), 1
    while size:
        front = _few(frontier.select(F.col("v").alias("src"), "dist"), size)
        found = steps.join(front, "src").select(F.col("dst").alias("v"), (F.col("dist") + F.col("w")).alias("dist"))
        found = found.where(F.col("dist") <= within).groupBy("v").agg(F.min("dist").alias("dist"))
        was = _few(known.select("v", F.col("dist").alias("was")), n_known)
        frontier = written(found.join(was, "v", "left").where("was IS NULL OR dist < was").select("v", "dist"))
        size = frontier.count()
        if size:
            rounds.append(frontier)
            known = union(rounds).groupBy("v").agg(F.min("dist").alias("dist"))
            n_known += size
            if len(rounds) % 8 == 0:
                rounds = [written(known)]
                known = rounds[0]
    forget(steps)
    return known.select(F.col("v").alias("vertex_id"), F.col("dist").alias("distance"))


def search_nearby(g: PropertyGraph, source: str, within: float, key: str) -> DataFrame:
    """nearby() over the edges that have a key, with its value as the weight (1 where it is no number)."""
    access = MapAccess()
    return nearby(g.edges.where(access.has(key)).select("src", "dst", access.number(key).alias("w")), source, within)
