"""Work that must not grow: tables written again without need, maps made by lambdas or twice, tasks that hold a whole batch."""

import os

from pyspark.sql import functions as F

from weftgraph.functions.attributes import untagged
from weftgraph.model import EdgeTable, PropertyGraph, VertexTable, WideGraph, edge_rows, type_rows, vertex_rows
from weftgraph.operators import mutate, select
from weftgraph.plans.session import Session
from weftgraph.sources import storage
from weftgraph.streaming.changelog import ChangeLog


def small(spark) -> PropertyGraph:
    vertices = vertex_rows(spark, [("a", "t", {"x": 1}), ("b", "t", {"y": "two"}), ("c", None, {})])
    return PropertyGraph(vertices, edge_rows(spark, [("e1", "a", "b", {"k": 1}), ("e2", "b", "c", {"l": 2.5}), ("e3", "b", "b", {"k": None})]), type_rows(spark, [("t", "t", ["x"])]))


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_only_changed_tables_are_written_after_a_statement(spark, tmp_path):
    """change_events, followed_changes, lang_batch."""
    log = ChangeLog(spark, f"file://{tmp_path}/log")
    s = Session(small(spark), write_after=1, log=log)
    before = s.graph
    s.execute("alter vertex(x:1) change {z:3}")
    assert s.graph.edges is before.edges and s.graph.types is before.types and s.graph.vertices is not before.vertices
    s.execute('create vertex {who:"Bob"} alter delete vertex(who:"Bob")')
    assert s.graph.edges is before.edges  # none of them has gone
    s.execute("create edge vertex(x:)-[m:1]->vertex(y:)")
    added = s.graph
    s.execute("create type {name:\"u\", v}")
    assert s.graph.edges is added.edges
    s.execute("alter delete vertex(y:)")
    assert s.graph.edges.count() == 0 and s.graph.vertices.count() == 2
    lost = log.read().where("version = 6 AND kind = 'edge'").select("op", "id").collect()
    assert len(lost) == 4 and {r.op for r in lost} == {"remove"} and {"e1", "e2", "e3"} < {r.id for r in lost}


def test_a_save_writes_only_what_is_new(spark, tmp_path):
    """autosaved, save_in_place."""
    path = f"{tmp_path}/graph"
    s = Session(small(spark), path=path, autosave=True)
    for name in ("d", "e", "f"):
        s.execute(f'create vertex {{n:"{name}"}}')
        if name != "d":
            version = storage.current_version(spark, path)
            assert not os.path.exists(f"{path}/tables/{version}/edges") and spark.read.parquet(f"{path}/tables/{version}/vertices").count() == 1
    g = storage.load(spark, path)
    assert g.counts() == {"vertices": 6, "edges": 3, "types": 1}
    s.execute("alter delete vertex(x:)")
    assert storage.load(spark, path).counts() == {"vertices": 5, "edges": 2, "types": 1}


def test_attribute_maps_are_compiled_and_leave_out_nulls(spark):
    """create_edge_cross, create_edge_bidir, search_nearby_by_key."""
    frame = spark.createDataFrame([(1, 2, 0.5, "p", None), (2, 1, None, "q", True), (3, 3, None, None, None)], "k long, o long, w double, name string, b boolean")
    t = VertexTable(frame, "k", "v:", ("name", "b"))
    g = WideGraph({"v": t}, {"near": [EdgeTable(frame, "v", "k", "v", "o", {"w": "w", "name": "name"})], "bare": [EdgeTable(frame, "v", "k", "v", "o")]}).to_map_layout()
    assert "lambda" not in plan(g.edges) + plan(g.vertices)
    got = {r.id: {k: untagged(v) for k, v in r.attrs.items()} for r in g.vertices.collect()}
    assert got == {"v:1": {"name": "p"}, "v:2": {"name": "q", "b": True}, "v:3": {}}
    edges = sorted((r.src, sorted((k, untagged(v)) for k, v in r.attrs.items())) for r in g.edges.collect())
    assert edges == [("v:1", [("bare", None)]), ("v:1", [("name", "p"), ("near", None), ("w", 0.5)]), ("v:2", [("bare", None)]), ("v:2", [("name", "q"), ("near", None)]), ("v:3", [("bare", None)]), ("v:3", [("near", None)])]


def test_text_form_with_few_and_many_attributes_is_read_once(spark, tmp_path):
    """roundtrip, roundtrip_members, roundtrip_edges, roundtrip_types, text_manifest."""
    values = ["a b%20\n", "", 5, -1.5, True, None, "'", "*", 1e300]
    edges = [(f"e {n}", "a", "b", {f"K%{i} {n}": values[i] for i in range(n)}) for n in (0, 1, 5, 6, 7, 9)]
    g = PropertyGraph(small(spark).vertices, edge_rows(spark, edges), type_rows(spark, [("t", "t", ["x"])]))
    path = f"file://{tmp_path}/text"
    storage.export_text(g, path)
    back = storage.import_text(spark, path)
    content = lambda h: {r.id: {k: (type(untagged(v)), untagged(v)) for k, v in r.attrs.items()} for r in h.edges.collect()}
    assert content(back) == content(g) and len(content(g)) == 6
    found = select.select_edges(back, "k%0 1").select("src", "attrs")
    assert found.count() == 1 and plan(found).count("map_from_entries") == 1


def test_large_batches_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    """bulk_add_rejects."""
    monkeypatch.setattr(mutate, "FEW", 2)
    monkeypatch.setattr(mutate, "ROWS_A_TASK", 2)
    new = vertex_rows(spark, [("a", None, {"p": 1}), ("x", None, {}), ("x", "t", {}), ("y", None, {}), ("z", None, {}), ("c", None, {})])
    new = new.unionByName(new.where("id = 'z'").withColumn("id", F.lit(None).cast("string")))
    g, rejected = mutate.add_vertices(small(spark), new)
    assert sorted(r.id for r in rejected.collect()) == ["a", "c", "x"]
    ids = sorted(r.id for r in g.vertices.collect())
    assert len(ids) == 7 and {"a", "b", "c", "x", "y", "z"} < set(ids)
    assert "RepartitionByExpression [id" in plan(rejected) and rejected.rdd.getNumPartitions() == 3


def test_edges_without_the_key_lie_still_when_others_go(spark):
    """delete_edge."""
    s = Session(small(spark))
    s.execute("alter delete edge(vertex(x:), vertex(y:), k)")
    assert sorted(r.id for r in s.graph.edges.collect()) == ["e2", "e3"]
    assert "Union" in plan(s.graph.edges)


def test_edges_of_a_set_as_text(spark):
    """edges_in_regions_as_text."""
    g = small(spark)
    got = select.edges_as_text(g, within=select.select_edges(g, "l")).collect()
    assert [tuple(r) for r in got] == [("e2", "Source : b \nTarget : c \nl : 2.5 \n")]


def test_attributes_are_set_and_taken_where_keys_are_held(spark):
    """set_and_remove_edge_attributes."""
    h = mutate.remove_attributes(mutate.set_attributes(small(spark), F.lit(True), {"K": 7, "w": 1}, on="edges"), F.lit(True), ["L"], on="edges")
    got = {r.id: {k: untagged(v) for k, v in r.attrs.items()} for r in h.edges.collect()}
    assert got == {"e1": {"k": 7, "w": 1}, "e2": {"k": 7, "w": 1}, "e3": {"k": 7, "w": 1}}
    assert "map_contains_key" in plan(h.edges) or "array_contains" in plan(h.edges)
