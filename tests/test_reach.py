"""The reachability queries beyond the 8 hops of their SQL, against plain Python."""

import os

import pytest

from tests.test_random_graphs import bfs
import __spark_entry__  # noqa: F401  registers the queries
from weftgraph.registry import QUERIES


@pytest.fixture(scope="module")
def long_way(spark, data, tmp_path_factory):
    """The given tables with lineitem a chain from s:0 to s:50 (and to s:5), all parts of size 10, of 10 hops."""
    d = tmp_path_factory.mktemp("reach")
    for name in os.listdir(data):
        if not name.startswith(("lineitem", "part.")):
            os.symlink(f"{data}/{name}", d / name)
    pairs = [(0, 1), (1, 1), (1, 2), (2, 2), (2, 3), (3, 3), (3, 4), (4, 4), (4, 5), (50, 5), (5, 5)]
    line = spark.read.parquet(f"{data}/lineitem.parquet")
    rows = spark.createDataFrame(pairs, "l_suppkey long, l_partkey long")
    like = line.limit(1).drop("l_suppkey", "l_partkey", "l_quantity").crossJoin(rows).selectExpr("*", "1.0 as l_quantity")
    like.select([like[f.name].cast(f.dataType) for f in line.schema]).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    spark.read.parquet(f"{data}/part.parquet").selectExpr("* except (p_size)", "cast(10 as bigint) as p_size").write.parquet(f"{d}/part.parquet")
    return str(d), [(a, b, 1.0) for s, p in pairs for a, b in ((f"s:{s}", f"p:{p}"), (f"p:{p}", f"s:{s}"))]


def test_distances_have_no_bound(spark, long_way):
    d, edges = long_way
    want = bfs(edges, "s:0")
    assert max(want.values()) == 10
    assert {r.vertex_id: r.hops for r in QUERIES["bfs_distance"](spark, d).collect()} == want


@pytest.mark.parametrize(("name", "target"), [("bfs_path", "s:50"), ("bfs_path_reversed", "s:50"), ("bfs_path_predicate", "s:5")])
def test_paths_have_no_bound(spark, long_way, name, target):
    d, _ = long_way
    path = [r.vertex_id for r in QUERIES[name](spark, d).orderBy("step").collect()]
    want = ["s:0", "p:1", "s:1", "p:2", "s:2", "p:3", "s:3", "p:4", "s:4", "p:5", target]
    assert path == (want[::-1] if name.endswith("reversed") else want)
