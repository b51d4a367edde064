import os

import pytest
from pyspark.sql import functions as F

from tests.graphs import social, students
from weftgraph.model import PropertyGraph, edge_rows, empty_graph, type_rows, vertex_rows
from weftgraph.operators import mutate
from weftgraph.plans.session import Session
from weftgraph.sources import storage
from weftgraph.streaming.changelog import ChangeLog, autosave, changes


def content(g):
    rows = lambda f, *cols: sorted(map(repr, f.select(*cols, F.to_json(F.array_sort(F.map_entries("attrs")))).collect()))
    return rows(g.vertices, "id", "type_id"), rows(g.edges, "id", "src", "dst"), rows(g.types, "id", "name", "attr_order")


def odd(spark):
    vertices = [("v 1", "t%1", {}), ("v2", "t%1", {"a b": "x y%20"}), ("v3", None, {"a": None, "b": 2.0, "c": -3}), ("v4", None, {"t": True, "e": 1e300, "q": "it's\n'", "s": ""})]
    return PropertyGraph(vertex_rows(spark, vertices), edge_rows(spark, [("e 1", "v 1", "v2", {}), ("e2", "v2", "v2", {"w": 0.5})]), type_rows(spark, [("t%1", "Big type", ["a", "b"]), ("t2", "Empty", ["c"])]))


def test_parquet_round_trip(spark, tmp_path):
    for i, g in enumerate((social(spark), odd(spark))):
        storage.save(g, f"{tmp_path}/{i}")
        assert content(storage.load(spark, f"{tmp_path}/{i}")) == content(g)


def test_text_round_trip(spark, tmp_path):
    for i, g in enumerate((social(spark), odd(spark))):
        storage.export_text(g, f"{tmp_path}/g{i}")
        assert content(storage.import_text(spark, f"{tmp_path}/g{i}")) == content(g)


def test_text_from_elsewhere(spark, tmp_path):
    (tmp_path / "x_Vertex.gdbt").write_text("p 3 Name 'Pei' Age 22 H 1.5\n\nq 0\n\n")
    (tmp_path / "x_Type.gdbt").write_text("t Student 2 Name * Num * 2 p q\n\n")
    (tmp_path / "x_Edge.gdbt").write_text("e p q 1 friend *\n\n")
    g = storage.import_text(spark, f"{tmp_path}/x")
    assert [r.type_id for r in g.vertices.collect()] == ["t", "t"]
    assert [r.attr_order for r in g.types.collect()] == [["name", "num"]]
    assert {r.t for r in g.vertices.where("id = 'p'").select(F.explode("attrs").alias("k", "v")).select("v.t").collect()} == {"string", "int", "double"}


def test_change_log(spark, tmp_path):
    g = social(spark)
    h = mutate.set_attributes(g, F.col("id") == "aaa", {"age": 5})
    h, _ = mutate.remove_vertices(h, spark.createDataFrame([("ccc",)], "id string"))
    found = {(r.kind, r.op, r.id) for r in changes(g, h, 1).collect()}
    assert found == {("vertex", "change", "aaa"), ("vertex", "remove", "ccc"), ("edge", "remove", "BC")}
    log = ChangeLog(spark, f"{tmp_path}/log")
    log.append(g, h, 1)
    seen = []
    log.follow(lambda batch, n: seen.extend(r.id for r in batch.collect()), "watch", kind="vertex").awaitTermination(120)
    log.append(h, g, 2)
    log.follow(lambda batch, n: seen.extend(f"again {r.op} {r.id}" for r in batch.collect()), "watch", kind="vertex").awaitTermination(120)
    assert sorted(seen) == ["aaa", "again add ccc", "again change aaa", "ccc"]
    log.follow(autosave(lambda: g, f"{tmp_path}/saved"), "save").awaitTermination(120)
    assert storage.load(spark, f"{tmp_path}/saved").vertices.count() == 8


def test_saving_in_place_keeps_the_graph(spark, tmp_path):
    path = f"{tmp_path}/g"
    storage.save(social(spark), path)
    with pytest.raises(FileExistsError):
        storage.save(social(spark), path)
    for age in (5, 6, 7):
        g = mutate.set_attributes(storage.load(spark, path), F.col("id") == "aaa", {"age": age})
        want = content(g)
        storage.save(g, path, mode="overwrite")
        assert content(storage.load(spark, path)) == want
    assert len([x for x in os.listdir(path) if x.startswith("v-")]) == 2
    text = f"{tmp_path}/t"
    storage.export_text(social(spark), text)
    for _ in range(2):
        storage.export_text(storage.import_text(spark, text), text)
    assert content(storage.import_text(spark, text)) == content(social(spark))
    version = storage.current_version(spark, path)  # a save that is cut off before the pointer is in place
    os.rename(f"{path}/{storage.POINTER}", f"{path}/{storage.POINTER}.{version}")
    assert content(storage.load(spark, path)) == want
    with pytest.raises(FileNotFoundError):
        storage.load(spark, f"{tmp_path}/nowhere")


def test_session_opens_changes_saves_and_tells(spark, tmp_path):
    path, log = f"{tmp_path}/db", ChangeLog(spark, f"{tmp_path}/log")
    storage.save(students(spark), path)
    s = Session.open(spark, path, log=log, autosave=True)
    told = []
    s.subscribe(lambda rows, version: told.append((version, {(r.kind, r.op) for r in rows.collect()})))
    s.execute('create vertex {type(name:"Student"){"Ann", 7}} create edge vertex(Name:"Ann")-[knows]-vertex(Name:"Peiming")')
    s.execute('alter vertex(Name:"Ann") change {Age:"30"} alter type(name:"Student") change {Num:Number} create type {name:"Other", a} create type {name:"Other", b}')
    s.execute('alter delete edge(vertex(Name:"Ann"), vertex(Name:"Peiming"), knows) alter delete vertex(Name:"Peiming") change {Age} alter delete vertex(Name:"Ann") alter delete type(name:"Other")')
    want = [
        {("vertex", "add")}, {("edge", "add")}, {("vertex", "change")}, {("type", "change"), ("vertex", "change")}, {("type", "add")}, set(),
        {("edge", "remove")}, {("vertex", "change")}, {("vertex", "remove"), ("edge", "remove")}, {("type", "remove")},
    ]
    assert told == list(enumerate(want, 1))
    assert log.read().where("version = 3").select(F.get_json_object("payload", "$.attrs[0].value.s")).first()[0] == "30"
    assert content(Session.open(spark, path).graph) == content(s.graph) and s.graph.vertices.count() == 3
    assert Session.open(spark, path, log=log)._version == 10
    s.save(f"{tmp_path}/copy")
    assert s.path == f"{tmp_path}/copy" and content(storage.load(spark, s.path)) == content(s.graph)
    with pytest.raises(ValueError):
        Session(students(spark)).save()
    with pytest.raises(ValueError):
        Session(students(spark), autosave=True)


def test_saved_where_a_new_session_makes_the_graph(spark, tmp_path):
    s = Session(empty_graph(spark), path=f"{tmp_path}/new", autosave=True)
    s.execute("create vertex {a:1} create vertex {b:2} create edge vertex(a:1)-[x:3]->vertex(b:2)")
    g = Session.open(spark, f"{tmp_path}/new").graph
    assert (g.vertices.count(), g.edges.count()) == (2, 1)
