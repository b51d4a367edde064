"""Connected components of an edge table, by contraction: every vertex with a smaller neighbour moves to its smallest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every vertex of edges (u, v: long): comp is the smallest id of its component.

    Each round writes the contracted edges; the vertices of a component at least halve, so rounds are logarithmic in the
    component's size, also for chains. A hub's neighbours are reduced by partial minima.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    labels = written(e.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("comp", F.col("id")), "labels")
    while not e.isEmpty():
        parent = written(e.groupBy("u").agg(F.min("v").alias("p")), "parent")
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = written(parent.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p")), "parent")
            forget(parent)
            parent = jumped
        of_v = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = e.join(parent, "u").join(of_v, "v", "left").select(F.col("p").alias("a"), F.coalesce("pv", "v").alias("b"))
        new_e = written(moved.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        new_labels = written(labels.join(parent.select(F.col("u").alias("comp"), "p"), "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "labels")
        forget(e, labels, parent)
        e, labels = new_e, new_labels
    forget(e)
    return labels
