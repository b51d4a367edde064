"""Traversals on random graphs against plain Python."""

import random
from collections import deque

import pytest

from weftgraph.operators import traverse


def bfs(edges, source, hops=99):
    seen, queue = {source: 0}, deque([source])
    while queue:
        v = queue.popleft()
        for s, d, _ in edges:
            if s == v and d not in seen and seen[v] < hops:
                seen[d] = seen[v] + 1
                queue.append(d)
    return seen


def ranges(edges, source, within):
    best = {}
    front = [(source, 0.0)]
    while front:
        new = []
        for v, x in front:
            for s, d, w in edges:
                if s == v and x + w <= within and x + w < best.get(d, float("inf")):
                    best[d] = x + w
                    new.append((d, x + w))
        front = new
    return best


@pytest.mark.parametrize("seed", range(3))
def test_against_python(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(4, 12)
    edges = [(f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}", float(rnd.randint(0, 4))) for _ in range(rnd.randint(3, 25))]
    frame = spark.createDataFrame(edges, "src string, dst string, w double")
    levels = bfs(edges, "v0")
    assert {r.v: r.h for r in traverse.bfs_levels(frame, "v0").collect()} == levels
    assert {r.v: r.h for r in traverse.bfs_levels(frame, "v0", max_hops=2).collect()} == bfs(edges, "v0", 2)
    assert {r.vertex_id: r.distance for r in traverse.nearby(frame, "v0", 6.0).collect()} == ranges(edges, "v0", 6.0)
    target = max(levels, key=levels.get)
    path = [r.vertex_id for r in traverse.shortest_path(frame, "v0", target).orderBy("step").collect()]
    assert len(path) == levels[target] + 1 and path[0] == "v0" and path[-1] == target
    assert all((a, b) in {(s, d) for s, d, _ in edges} for a, b in zip(path, path[1:], strict=False))
