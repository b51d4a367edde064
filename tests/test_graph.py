import pytest
from pyspark.sql import functions as F

from tests.graphs import ids, social
from weftgraph.functions.attributes import EXISTS, MapAccess, compares, untagged
from weftgraph.model import edge_rows, empty_graph, type_rows, vertex_rows
from weftgraph.operators import mutate, select, traverse


@pytest.fixture(scope="module")
def g(spark):
    return social(spark)


def path(frame):
    return [r.vertex_id for r in frame.orderBy("step").collect()]


def test_counts_and_scans(g):
    assert g.counts() == {"vertices": 8, "edges": 8, "types": 1}
    assert g.is_directed


def test_degrees(g):
    got = {r.id: (r.in_degree, r.out_degree) for r in select.degrees(g).collect()}
    assert got == {"peiming": (1, 3), "yidong": (1, 2), "weidong": (1, 0), "aaa": (1, 2), "bbb": (1, 1), "ccc": (1, 0), "ddd": (1, 0), "eee": (1, 0)}


def test_self_loop_counts_twice(spark, g):
    h, _ = mutate.add_edges(g, edge_rows(spark, [("L", "ccc", "ccc", {})]))
    assert [r.degree for r in select.degrees(h).where("id = 'ccc'").collect()] == [3]


def test_select_vertices(g):
    assert ids(select.select_vertices(g, "Age", "22")) == ["peiming", "weidong"]
    assert ids(select.select_vertices(g, "Age", 22)) == []
    assert ids(select.select_vertices(g, "game")) == ["peiming"]
    assert ids(select.select_vertices(g, "Age", "21", type="Student")) == ["yidong"]
    assert ids(select.select_vertices(g, "Age", "21", type="Nope")) == []
    assert ids(select.select_vertices(g, "Age", "21", where=lambda a: a.value("name")["s"] > "c")) == ["ccc", "ddd", "eee"]
    assert ids(select.select_vertices(g, "Age", within=g.vertices.where("seq < 2"))) == ["peiming", "yidong"]


def test_sorted_nulls_first_then_insertion(g):
    rows = select.select_vertices(g, order_by="game").collect()
    assert [r.id for r in rows] == ["yidong", "weidong", "aaa", "bbb", "ccc", "ddd", "eee", "peiming"]


def test_select_edges(g):
    assert ids(select.select_edges(g, "friend", 1)) == ["PA"]
    assert ids(select.select_edges(g, "friend", where=compares(MapAccess(), "friend", ">", 0.4))) == ["AE", "BC", "PA", "YD"]
    assert ids(select.select_edges(g, src="peiming")) == ["PA", "PW", "PY"]
    assert ids(select.incident_edges(g, "yidong")) == ["PY", "YD", "YP"]
    assert ids(select.incident_edges(g, "yidong", "in")) == ["PY"]


def test_presence_and_null_differ(g):
    assert ids(select.select_edges(g, "friend", EXISTS)) == sorted(["AE", "PA", "AB", "BC", "YD", "PY", "YP", "PW"])
    assert ids(select.select_edges(g, "friend", None)) == ["PW", "PY", "YP"]


def test_single(g):
    assert select.single(select.by_id(g.vertices, "aaa")).id == "aaa"
    assert select.single(select.by_id(g.vertices, "nobody")) is None
    with pytest.raises(select.NotSingleError):
        select.single(select.select_vertices(g, "Age", "21"))


def test_types(spark, g):
    assert ids(select.type_by_name(g, "Student")) == ["t1"]
    assert ids(select.types_with_attributes(g, ["name", "NUM"])) == ["t1"]
    assert ids(select.types_with_attributes(g, ["name", "age"])) == []
    assert {(r.type_name, r.n) for r in select.type_counts(g).collect()} == {("Student", 2), (None, 6)}


def test_parallel_edges(spark, g):
    h, _ = mutate.add_vertices(g, vertex_rows(spark, [("X", None, {})]))
    h, _ = mutate.add_edges(h, edge_rows(spark, [("n1", "peiming", "X", {"name": "add"}), ("n2", "peiming", "X", {"name": "add2"})]))
    assert ids(select.parallel_edges(h, "peiming", "X")) == ["n1", "n2"]
    assert [tuple(r) for r in select.parallel_pairs(h).collect()] == [("peiming", "X", 2)]


def test_text(g):
    texts = {r.id: r.text for r in select.vertices_as_text(g).collect()}
    assert texts["yidong"] == "age : 21 \nname : Yidong \nType : Student \nInDegree : 1 \nOutDegree : 2 \n"
    assert {r.id: r.text for r in select.edges_as_text(g).collect()}["PY"] == "Source : peiming \nTarget : yidong \nfriend* \n"


def test_paths(g):
    assert path(traverse.find_path(g, "peiming", "weidong")) == ["peiming", "weidong"]
    assert path(traverse.find_path(g, "peiming", "weidong", forward=False)) == ["weidong", "peiming"]
    assert path(traverse.find_path(g, "weidong", "peiming")) == []
    assert path(traverse.find_path(g, "peiming", "ccc")) == ["peiming", "aaa", "bbb", "ccc"]
    assert path(traverse.find_path(g, "peiming", "ddd", key="Age", value="22")) == []
    assert path(traverse.find_path(g, "peiming", "ccc", key="Age", value="21")) == ["peiming", "aaa", "bbb", "ccc"]
    assert path(traverse.find_path(g, "peiming", "ddd", where=compares(MapAccess(), "friend", ">", 0), on="edge")) == []
    assert path(traverse.find_path(g, "peiming", "peiming")) == ["peiming"]


def test_nearby(g):
    got = lambda r: {x.vertex_id: round(x.distance, 6) for x in traverse.search_nearby(g, "peiming", r, "friend").collect()}
    assert got(1) == {"aaa": 1, "yidong": 1, "weidong": 1}
    assert got(2) == {"aaa": 1, "yidong": 1, "weidong": 1, "eee": 1.5, "bbb": 1.1, "peiming": 2}


def test_nearby_bears_zero_cycles_and_refuses_negative_weights(spark):
    zero = spark.createDataFrame([("a", "b", 0.0), ("b", "a", 0.0)], "src string, dst string, w double")
    assert {r.vertex_id: r.distance for r in traverse.nearby(zero, "a", 1.0).collect()} == {"a": 0.0, "b": 0.0}
    with pytest.raises(ValueError):
        traverse.nearby(spark.createDataFrame([("a", "b", -1.0)], "src string, dst string, w double"), "a", 1.0)


def test_remove_vertex_cascades(spark, g):
    h, missing = mutate.remove_vertices(g, spark.createDataFrame([("peiming",), ("ghost",)], "id string"))
    assert h.vertices.count() == 7 and ids(h.edges) == ["AB", "AE", "BC", "YD"] and ids(missing) == ["ghost"]
    assert [(r.in_degree, r.out_degree) for r in select.degrees(h).where("id = 'yidong'").collect()] == [(0, 1)]


def test_remove_edges_and_types(spark, g):
    h, missing = mutate.remove_edges(g, spark.createDataFrame([("AE",), ("no",)], "id string"))
    assert h.edges.count() == 7 and ids(missing) == ["no"]
    h = mutate.remove_type_named(g, "Student")
    assert h.types.count() == 0 and h.vertices.where("type_id is not null").count() == 0 and h.vertices.count() == 8


def test_add_rejects(spark, g):
    h, rejected = mutate.add_vertices(g, vertex_rows(spark, [("aaa", None, {}), ("new", None, {}), ("new", None, {"x": 1})]))
    assert ids(rejected) == ["aaa", "new"] and h.vertices.count() == 9
    assert h.vertices.select("seq").distinct().count() == 9
    h, rejected = mutate.add_edges(g, edge_rows(spark, [("AE", "aaa", "bbb", {}), ("q", "aaa", "ghost", {}), ("r", "aaa", "bbb", {})]))
    assert ids(rejected) == ["AE", "q"] and h.edges.count() == 9
    h, rejected = mutate.add_types(g, type_rows(spark, [("t2", "Student", ["a"]), ("t3", "", ["a"]), ("t4", "Teacher", ["a"])]))
    assert ids(rejected) == ["t2", "t3"] and ids(h.types) == ["t1", "t4"]
    with pytest.raises(ValueError):
        edge_rows(spark, [("x", "aaa", None, {})])


def test_attributes(g):
    age = lambda h, i: untagged(h.vertices.where(F.col("id") == i).select(MapAccess().value("AGE").alias("v")).first().v)
    h = mutate.set_attributes(g, F.col("id") == "aaa", {"AGE": 7, "Tall": True})
    assert age(h, "aaa") == 7 and age(h, "bbb") == "21" and ids(select.select_vertices(h, "tall", True)) == ["aaa"]
    h = mutate.remove_attributes(h, F.col("id") == "aaa", ["Age"])
    assert ids(select.select_vertices(h.__class__(h.vertices.where("id = 'aaa'"), h.edges, h.types), "age")) == []
    assert mutate.clear_type(g, "t1").vertices.where("type_id is not null").count() == 0


def test_product_is_whole_and_its_ids_stay(g):
    h = mutate.connect(g, g.vertices, g.vertices, {"x": 1})
    ids_of = lambda: sorted(r.id for r in h.edges.collect())
    assert h.edges.count() == 8 + 64 and ids_of() == ids_of() and len(set(ids_of())) == 72
    assert mutate.connect(g, g.vertices, g.vertices, {"x": 1}, both=True).edges.count() == 8 + 128


def test_empty_graph(spark):
    g = empty_graph(spark)
    assert select.degrees(g).count() == 0 and ids(select.select_vertices(g, "a")) == []
    assert path(traverse.find_path(g, "a", "b")) == []
