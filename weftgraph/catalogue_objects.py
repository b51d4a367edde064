"""Queries for what catalogue.py leaves out: lookups and changes object by object, the language's statements, storage and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import EDGE_SQL, MATCH_SQL, MEMBERS, TYPE_COUNTS, VERTEX_SQL, copied, whole
from .functions.attributes import EXISTS, MapAccess
from .model import PropertyGraph, VertexTable, WideGraph, edge_rows, type_rows, vertex_rows
from .operators import mutate, select, traverse
from .plans.parser import GraphQueryError
from .plans.scratch import root, written
from .plans.session import Session
from .registry import query
from .sources import storage
from .sources.tables import trade_graph
from .streaming.changelog import ChangeLog, autosave


def _place(spark, what: str) -> str:
    return f"{root(spark)}/weftgraph-{what}-{uuid.uuid4().hex}"


def _stored(spark, d) -> PropertyGraph:
    """The whole graph as written tables: for several statements or hops on it, which would else plan its making each time."""
    g = whole(spark, d)
    return PropertyGraph(written(g.vertices), written(g.edges), g.types)


def _string(key: str):
    return MapAccess().value(key)["s"].alias(key)


# Lookups of single objects.


@query("SELECT 'c:7' AS id, c_name FROM customer WHERE c_custkey = 7")
def single_by_id(spark, d):
    row = select.single(select.by_id(whole(spark, d).vertices, "c:7"))
    return spark.createDataFrame([(row.id, row.attrs["c_name"].s)], "id string, c_name string")


@query("SELECT 's:' || s_suppkey AS id FROM supplier WHERE s_name = 'Supplier#000000003'")
def single_by_attribute(spark, d):
    row = select.single(select.select_vertices(whole(spark, d), "S_NAME", "Supplier#000000003"))
    return spark.createDataFrame([(row.id,)], "id string")


@query("SELECT * FROM (VALUES ('BUILDING', 'several'), ('NOWHERE', 'none')) t(segment, found)")
def single_errors(spark, d):
    """A lookup that finds several objects is an error; one that finds none gives nothing."""
    g, out = whole(spark, d), []
    for segment in ("BUILDING", "NOWHERE"):
        try:
            out.append((segment, "none" if select.single(select.select_vertices(g, "c_mktsegment", segment)) is None else "one"))
        except select.NotSingleError:
            out.append((segment, "several"))
    return spark.createDataFrame(out, "segment string, found string")


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_quantity = 10")
def map_select_edges(spark, d):
    return select.select_edges(whole(spark, d), "contains", 10.0).select("src", "dst")


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def edge_predicate(spark, d):
    return select.select_edges(whole(spark, d), "contains", where=lambda a: (a.number("contains") > 45) & (a.number("l_discount") < 0.02)).select("src", "dst")


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem")
def map_edges_to_types(spark, d):
    """Edges into parts that a set of edges holds: contains, of all edges into parts."""
    g = whole(spark, d)
    within = select.select_edges(g, "contains")
    return select.select_edges(g, where=F.col("dst").startswith("p:"), within=within).select("src", "dst")


PAIR = "(SELECT l_suppkey AS ps, l_partkey AS pp FROM lineitem GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)"


@query(f"SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, l_quantity FROM lineitem, {PAIR} WHERE l_suppkey = ps AND l_partkey = pp")
def map_parallel_edges(spark, d):
    (e,) = trade_graph(spark, d).edge_sets("supplies")
    top = e.frame.groupBy("s", "d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s", "d").first()
    found = select.parallel_edges(whole(spark, d), f"s:{top.s}", f"p:{top.d}", order_by="supplies")
    return found.select("src", "dst", MapAccess().number("supplies").alias("l_quantity"))


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS side, src, dst FROM ({EDGE_SQL}) WHERE {w}" for n, w in (("out", "src = 'n:3'"), ("in", "dst = 'n:3'"), ("both", "src = 'n:3' OR dst = 'n:3'"))
    )
)
def map_incident_edges(spark, d):
    g = whole(spark, d)
    parts = [select.incident_edges(g, "n:3", side).select(F.lit(side).alias("side"), "src", "dst") for side in ("out", "in", "both")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT * FROM (VALUES ('by key', 'customer'), ('by key', 'order'), ('by condition', 'customer'), ('within', 'part')) t(how, name) WHERE NOT (how = 'by key' AND name = 'order')")
def select_types_all_ways(spark, d):
    g = whole(spark, d)
    by_key = select.select_types(g, "c_name").select(F.lit("by key").alias("how"), "name")
    by_condition = select.select_types(g, where=lambda a: a.has("c_acctbal")).select(F.lit("by condition").alias("how"), "name")
    within = select.select_types(g, "p_size", within=g.types.where("name IN ('part', 'order')")).select(F.lit("within").alias("how"), "name")
    return by_key.unionByName(by_condition).unionByName(within)


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def vertices_within_a_set(spark, d):
    g = whole(spark, d)
    urgent = select.select_vertices(g, "o_orderpriority", "1-URGENT").select(F.col("id").alias("dst"))
    buyers = select.select_edges(g, "placed").join(urgent, "dst", "left_semi").select(F.col("src").alias("id"))
    return select.select_vertices(g, "c_mktsegment", "BUILDING", within=buyers).select("id")


@query(f"SELECT * FROM (SELECT 'vertices' AS what, count(*) AS n FROM ({VERTEX_SQL}) UNION ALL SELECT 'edges', count(*) FROM ({EDGE_SQL}) UNION ALL SELECT 'types', 6)")
def cardinalities(spark, d):
    return spark.createDataFrame(sorted(whole(spark, d).counts().items()), "what string, n bigint")


@query(EDGE_SQL)
def edge_scan(spark, d):
    return whole(spark, d).edges.select("src", "dst")


@query("SELECT true AS directed")
def directed(spark, d):
    return spark.createDataFrame([(whole(spark, d).is_directed,)], "directed boolean")


DEGREES = f"(SELECT dst AS v, count(*) AS i FROM ({EDGE_SQL}) GROUP BY 1)", f"(SELECT src AS v, count(*) AS o FROM ({EDGE_SQL}) GROUP BY 1)"


@query(
    "SELECT m.id, 'n_name : ' || n_name || ' ' || chr(10) || 'Type : nation ' || chr(10) || 'InDegree : ' || coalesce(i, 0) || ' ' || chr(10) || 'OutDegree : ' || coalesce(o, 0) || ' ' || chr(10) AS text "
    f"FROM (SELECT 'n:' || n_nationkey AS id, n_name FROM nation) m LEFT JOIN {DEGREES[0]} x ON x.v = m.id LEFT JOIN {DEGREES[1]} y ON y.v = m.id"
)
def nations_as_text(spark, d):
    return select.vertices_as_text(whole(spark, d)).where("id LIKE 'n:%'")


@query("SELECT 'n:' || n_nationkey AS src, 'Source : n:' || n_nationkey || ' ' || chr(10) || 'Target : r:' || n_regionkey || ' ' || chr(10) || 'in_region* ' || chr(10) AS text FROM nation")
def edges_in_regions_as_text(spark, d):
    g = whole(spark, d)
    found = written(select.select_edges(g, "in_region").select("id", "src"))
    return select.edges_as_text(g, within=found).join(found, "id").select("src", "text")


# Changes object by object and in bulk.


@query("SELECT * FROM (VALUES ('added', 'a'), ('added', 'b'), ('rejected', 'customer'), ('rejected', 'a'), ('rejected', '')) t(what, name)")
def bulk_add_types(spark, d):
    g = whole(spark, d)
    h, rejected = mutate.add_types(g, type_rows(spark, [("t1", "a", ["x"]), ("t2", "b", []), ("t3", "customer", ["y"]), ("t4", "a", ["z"]), ("t5", "", [])]))
    added = h.types.join(g.types.select("id"), "id", "left_anti")
    return added.select(F.lit("added").alias("what"), "name").unionByName(rejected.select(F.lit("rejected").alias("what"), "name"))


@query(f"SELECT CASE WHEN t IN ('customer', 'part') THEN NULL ELSE t END AS type_id, sum(n)::BIGINT AS n FROM ({TYPE_COUNTS}) GROUP BY 1 UNION ALL SELECT 'not there: nope', 1")
def bulk_remove_types(spark, d):
    h, missing = mutate.remove_types(whole(spark, d), spark.createDataFrame([("customer",), ("part",), ("nope",)], "id string"))
    left = h.vertices.groupBy("type_id").agg(F.count("*").alias("n"))
    return left.unionByName(missing.select(F.concat(F.lit("not there: "), "id").alias("type_id"), F.lit(1).cast("bigint").alias("n")))


@query(f"SELECT id, CASE WHEN id LIKE 'n:%' THEN 'region' WHEN id LIKE 'c:%' THEN NULL ELSE type_id END AS type_id FROM ({MEMBERS}) WHERE id NOT LIKE 'o:%' AND id NOT LIKE 'p:%'")
def attach_and_detach(spark, d):
    h = mutate.set_type(whole(spark, d), F.col("type_id") == "nation", "region")
    return mutate.clear_type(h, "customer").vertices.where("NOT (id LIKE 'o:%' OR id LIKE 'p:%')").select("id", "type_id")


@query("SELECT 'vertex' AS kind, 'c:none' AS id UNION ALL SELECT 'edge', 'e:none'")
def bulk_remove_rejects(spark, d):
    g = whole(spark, d)
    _, vertices = mutate.remove_vertices(g, g.vertices.where("id LIKE 'c:%'").select("id").unionByName(spark.createDataFrame([("c:none",)], "id string")))
    _, edges = mutate.remove_edges(g, select.select_edges(g, "placed").select("id").unionByName(spark.createDataFrame([("e:none",)], "id string")))
    return vertices.select(F.lit("vertex").alias("kind"), "id").unionByName(edges.select(F.lit("edge").alias("kind"), "id"))


@query(EDGE_SQL.replace("SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders UNION ALL ", "", 1))
def bulk_remove_edges(spark, d):
    g = whole(spark, d)
    return mutate.remove_edges(g, select.select_edges(g, "placed"))[0].edges.select("src", "dst")


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, l_quantity * 0 + 1.5 AS weight FROM lineitem WHERE l_quantity > 45")
def set_and_remove_edge_attributes(spark, d):
    g = whole(spark, d)
    heavy = F.coalesce(MapAccess().number("contains") > 45, F.lit(False))
    h = mutate.remove_attributes(mutate.set_attributes(g, heavy, {"weight": 1.5}, on="edges"), F.lit(True), ["l_discount"], on="edges")
    found = select.select_edges(h, "weight", where=lambda a: ~a.has("l_discount"))
    return found.select("src", "dst", MapAccess().number("weight").alias("weight"))


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS ids FROM (SELECT c_custkey FROM customer UNION ALL SELECT s_suppkey FROM supplier)")
def generated_ids(spark, d):
    """Vertices that come without ids get different ones, which stay the same when looked at again."""
    g = trade_graph(spark, d).to_map_layout()
    new = g.vertices.where("type_id IN ('customer', 'supplier')").select(F.lit(None).cast("string").alias("id"), "type_id", "attrs")
    h, _ = mutate.add_vertices(g, new)
    added = h.vertices.join(g.vertices.select("id"), "id", "left_anti")
    return added.join(h.vertices.select("id"), "id", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


# The language.


@query("SELECT name FROM (VALUES ('part')) t(name)")
def lang_type_by_name(spark, d):
    return Session(whole(spark, d)).query('select t from type(name:"part")').select("name")


@query("SELECT name FROM (VALUES ('customer')) t(name)")
def lang_types_with_keys(spark, d):
    return Session(whole(spark, d)).query("select t from type(c_name, C_ACCTBAL)").select("name")


URGENT_TO_SMALL = "SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderpriority = '1-URGENT' AND p_size = 10"


@query(URGENT_TO_SMALL)
def lang_edges(spark, d):
    return Session(whole(spark, d)).query('select e from edge(vertex(type(name:"order"),o_orderpriority:"1-URGENT"), vertex(type(name:"part"),p_size:10))')


@query(URGENT_TO_SMALL + " AND l_quantity >= 20 AND l_quantity < 40 AND l_discount > 0.03")
def lang_edges_with_conditions(spark, d):
    text = 'select e from edge(vertex(type(name:"order"),o_orderpriority:"1-URGENT"), vertex(type(name:"part"),p_size:10), contains>=20, contains<40, l_discount>0.03)'
    return Session(trade_graph(spark, d)).query(text)


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def lang_vertices(spark, d):
    return Session(trade_graph(spark, d)).query('select v from vertex(type(name:"customer"),c_mktsegment:"BUILDING").')


@query("SELECT 's:' || s_suppkey AS id FROM supplier WHERE s_name = 'Supplier#000000003'")
def lang_vertices_of_any_type(spark, d):
    return Session(trade_graph(spark, d)).query('select v from vertex(s_name:"Supplier#000000003").')


@query(MATCH_SQL)
def lang_path_in_the_map_layout(spark, d):
    text = 'select m from vertex(type(name:"part"),p_size:10) match vertex(type(name:"customer"),c_mktsegment:"BUILDING")-[placed]->vertex(type(name:"order"),o_orderpriority:"1-URGENT")-[contains]->m.'
    return Session(_stored(spark, d), strict=False).query(text)


@query(
    "SELECT 's:' || s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name <> '') "
    "AND EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_brand = 'Brand#12')"
)
def lang_star(spark, d):
    text = 'select m from vertex(type(name:"supplier")) match m-[supplies]->vertex(type(name:"part"),p_brand:"Brand#12")-[in_nation]->vertex(type(name:"nation"),n_name:).'
    return Session(trade_graph(spark, d), strict=False).query(text)


@query("SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def lang_any_hop(spark, d):
    return Session(trade_graph(spark, d)).query('select m from vertex(type(name:"order")) match vertex(type(name:"customer"),c_mktsegment:"BUILDING")-[]->m.')


def _dashed(spark, d) -> PropertyGraph:
    """Customers and orders with ids that the language can write (c-7)."""
    g = trade_graph(spark, d)
    tables = {n: VertexTable(t.frame, t.key, t.prefix.replace(":", "-"), t.attributes) for n, t in g.vertex_tables.items() if n in ("customer", "order")}
    return WideGraph(tables, {"placed": g.edge_tables["placed"]}).to_map_layout()


@query("SELECT 'c-' || o_custkey AS src, 'o-' || o_orderkey AS dst FROM orders WHERE o_custkey <> 7")
def lang_delete_vertex_by_id(spark, d):
    s = Session(_dashed(spark, d))
    s.execute("alter delete vertex(c-7)")
    return s.graph.edges.select("src", "dst")


@query("SELECT NULL AS type_id, count(*) AS n FROM customer UNION ALL SELECT 'order', count(*) FROM orders")
def lang_delete_type_by_id(spark, d):
    s = Session(_dashed(spark, d))
    s.execute("alter delete type(customer)")
    return s.graph.vertices.groupBy("type_id").agg(F.count("*").alias("n"))


@query("SELECT 'n:' || n_nationkey AS src, 'y:' || n_nationkey AS dst FROM nation WHERE false UNION ALL SELECT 'Ann', n_name FROM nation")
def lang_batch(spark, d):
    """Statements in a row, each on what those before it have left."""
    s = Session(whole(spark, d), write_after=2)
    s.execute('create type {name:"guide", who} create vertex {type(name:"guide"){"Ann"}} create vertex {who:"Bob"}; alter delete vertex(who:"Bob")')
    s.execute('create edge vertex(who:)-[leads:1]->vertex(n_name:) alter type(name:"guide") change {"leader", who:name}')
    g = s.graph
    ends = g.vertices.select("id", F.coalesce(_string("name"), _string("n_name")).alias("label"))
    led = select.select_edges(g, "leads").select("src", "dst")
    return led.join(ends.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


FAULTS = (
    ("drop everything", 0),
    ('alter vertex(c_mktsegment:"BUILDING") merge {height:180}', 1),
    ('alter delete vertex(c_name:"Nobody")', 2),
    ('alter delete type(name:"nope")', 3),
    ('alter delete edge(vertex(c_mktsegment:"BUILDING"), vertex(n_name:), placed)', 4),
    ('alter type(name:"customer") change {nope:x}', 5),
    ('alter type(name:"customer") change {c_name:c_acctbal}', 6),
    ('select v from vertex(type(name:"customer"),c_name:"Nobody").', 7),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {c}, true)" for t, c in FAULTS) + ") t(statement, code, unchanged)")
def lang_errors(spark, d):
    s, out = Session(whole(spark, d)), []
    for text, _ in FAULTS:
        before = s.graph
        try:
            s.execute(text)
        except GraphQueryError as e:
            out.append((text, e.code, s.graph is before))
    return spark.createDataFrame(out, "statement string, code int, unchanged boolean")


# Storage and events.


@query("SELECT 'c:' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SAVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def save_in_place(spark, d):
    """Opened, changed, saved where it was opened, and opened again."""
    path = _place(spark, "saved")
    storage.save(whole(spark, d), path)
    s = Session.open(spark, path)
    s.execute('alter vertex(c_mktsegment:"BUILDING") change {c_mktsegment:"SAVED"}')
    s.save()
    g = Session.open(spark, path).graph
    return select.select_vertices(g, "c_mktsegment", type="customer").select("id", _string("c_mktsegment"))


@query(f"SELECT src, dst FROM ({EDGE_SQL}) WHERE dst NOT IN (SELECT 'r:' || r_regionkey FROM region) UNION ALL SELECT 'added', 'edges: 0'")
def autosaved(spark, d):
    """What a second session finds after each statement has saved by itself."""
    path = _place(spark, "auto")
    s = Session(whole(spark, d), path=path, autosave=True)
    s.execute("alter delete vertex(r_name:)")
    left = Session.open(spark, path).graph
    s.execute('create vertex {a:"unlinked"}')
    alone = select.select_edges(Session.open(spark, path).graph, where=F.col("src").isNull()).count()
    return left.edges.select("src", "dst").unionByName(spark.createDataFrame([("added", f"edges: {alone}")], "src string, dst string"))


EVENTS = (
    "SELECT 1::BIGINT AS version, 'vertex' AS kind, 'change' AS op, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' "
    "UNION ALL SELECT 2, 'vertex', 'remove', count(*) FROM customer WHERE c_mktsegment = 'FURNITURE' "
    "UNION ALL SELECT 2, 'edge', 'remove', count(*) FROM customer WHERE c_mktsegment = 'FURNITURE' "
    "UNION ALL SELECT 2, 'edge', 'remove', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'FURNITURE' "
    "UNION ALL SELECT 3, 'edge', 'add', count(*) FROM supplier, region UNION ALL SELECT 4, 'type', 'add', 1 "
    "UNION ALL SELECT 5, 'type', 'remove', 1 UNION ALL SELECT 5, 'vertex', 'change', count(*) FROM part"
)
STATEMENTS = 'alter vertex(c_mktsegment:"BUILDING") change {c_acctbal:0.5} alter delete vertex(c_mktsegment:"FURNITURE") create edge vertex(s_name:)-[visits]->vertex(r_name:) create type {name:"x", y} alter delete type(name:"part")'


@query(f"SELECT version, kind, op, sum(n)::BIGINT AS n FROM ({EVENTS}) GROUP BY ALL")
def change_events(spark, d):
    """What a session writes to the change log, statement by statement."""
    log = ChangeLog(spark, _place(spark, "log"))
    Session(whole(spark, d), log=log, write_after=1).execute(STATEMENTS)
    return log.read().groupBy("version", "kind", "op").agg(F.count("*").alias("n"))


@query("SELECT 'c:' || c_custkey AS id, 0.5::DOUBLE AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def change_payload(spark, d):
    """The changed objects as the log has them."""
    log = ChangeLog(spark, _place(spark, "log"))
    Session(whole(spark, d), log=log).execute('alter vertex(c_mktsegment:"BUILDING") change {c_acctbal:0.5}')
    entries = F.from_json("payload", "struct<attrs:array<struct<key:string,value:struct<d:double>>>>")["attrs"]
    return log.read().select("id", F.filter(entries, lambda e: e["key"] == "c_acctbal")[0]["value"]["d"].alias("c_acctbal"))


@query("SELECT 'change' AS op, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'remove', count(*) FROM customer WHERE c_mktsegment = 'FURNITURE'")
def followed_changes(spark, d):
    """A subscriber that follows vertex changes as a stream, while another one saves the graph."""
    log, seen = ChangeLog(spark, _place(spark, "log")), []
    s = Session(whole(spark, d), log=log, write_after=1)
    s.execute(STATEMENTS.split(" create edge")[0])
    log.follow(lambda batch, _: seen.extend(map(tuple, batch.groupBy("op").count().collect())), "counts", kind="vertex").awaitTermination()
    saved = _place(spark, "saved")
    log.follow(autosave(lambda: s.graph, saved), "save").awaitTermination()
    assert storage.current_version(spark, saved) is not None
    return spark.createDataFrame(seen, "op string, n bigint")


@query("SELECT * FROM (VALUES ('_Edge.gdbt'), ('_Type.gdbt'), ('_Vertex.gdbt')) t(suffix)")
def text_manifest(spark, d):
    path = _place(spark, "text")
    storage.export_text(whole(spark, d), path)
    return spark.read.text(path + storage.MANIFEST).select(F.regexp_extract("value", "_[A-Z][a-z]+[.]gdbt$", 0).alias("suffix"))


TYPE_KEYS = {n: list(t) for n, t in (("region", ("r_name",)), ("nation", ("n_name",)), ("supplier", ("s_name", "s_acctbal")))}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{','.join(k)}')" for n, k in TYPE_KEYS.items()) + ") t(name, keys)")
def roundtrip_types(spark, d):
    return copied(spark, d).types.where("name IN ('region', 'nation', 'supplier')").select("name", F.array_join("attr_order", ",").alias("keys"))


# Searches over the map layout.


PLACED_PATH = "WITH c AS (SELECT min(c_custkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey), o AS (SELECT min(o_orderkey) AS k FROM orders, c WHERE o_custkey = c.k) "


def _ends(spark, d) -> tuple[str, str]:
    orders = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    row = orders.agg(F.min(F.struct("o_custkey", "o_orderkey")).alias("m")).first().m
    return f"c:{row.o_custkey}", f"o:{row.o_orderkey}"


@query(PLACED_PATH + "SELECT 0 AS step, 'c:' || k AS vertex_id FROM c UNION ALL SELECT 1, 'o:' || k FROM o")
def find_path_by_edge_key(spark, d):
    a, b = _ends(spark, d)
    return traverse.find_path(whole(spark, d), a, b, key="placed", on="edge")


@query("SELECT 0 AS step, 'c:0' AS vertex_id UNION ALL SELECT 1, 'n:' || c_nationkey FROM customer WHERE c_custkey = 0 UNION ALL SELECT 2, 'r:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 0")
def find_path_by_vertex_key(spark, d):
    region = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey = 0").join(spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey") == F.col("c_nationkey")).first().n_regionkey
    return traverse.find_path(whole(spark, d), "c:0", f"r:{region}", key="N_NAME", value=EXISTS)


@query("SELECT 0 AS step, 'c:0' AS vertex_id WHERE false")
def find_path_where_none_is(spark, d):
    """No path leads through vertices that do not meet the condition."""
    return traverse.find_path(whole(spark, d), "c:0", "r:0", where=MapAccess().equals("n_name", "nowhere"))


@query("SELECT 0 AS step, 'r:' || n_regionkey AS vertex_id FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 1, 'n:0'")
def find_path_reversed(spark, d):
    region = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey = 0").first().n_regionkey
    return traverse.find_path(whole(spark, d), "n:0", f"r:{region}", where=F.lit(True), forward=False)


@query("SELECT 'p:' || l_partkey AS vertex_id, min(l_quantity) AS distance FROM lineitem WHERE l_suppkey = 0 GROUP BY 1 HAVING min(l_quantity) <= 5")
def search_nearby_by_key(spark, d):
    return traverse.search_nearby(whole(spark, d), "s:0", 5.0, "supplies")


@query("SELECT 'n:0' AS vertex_id, 0 AS hops UNION ALL SELECT 'r:' || n_regionkey, 1 FROM nation WHERE n_nationkey = 0")
def algorithm_plug_in(spark, d):
    return traverse.run(traverse.BreadthFirst("n:0"), whole(spark, d)).select(F.col("v").alias("vertex_id"), F.col("h").alias("hops"))


@query(f"SELECT count(*) AS n FROM ({VERTEX_SQL})")
def caller_algorithm(spark, d):
    """An algorithm of the caller's own: anything with run(graph)."""

    class Count:
        def run(self, graph: PropertyGraph) -> DataFrame:
            return graph.vertices.agg(F.count("*").alias("n"))

    return traverse.run(Count(), whole(spark, d))


@query("SELECT 'e1' AS id WHERE false")
def vertex_and_edge_rows_by_hand(spark, d):
    """Objects that are given row by row; edges with a missing end are rejected and none is added."""
    g, _ = mutate.add_vertices(whole(spark, d), vertex_rows(spark, [("x:1", None, {"a": 1})]))
    h, _ = mutate.add_edges(g, edge_rows(spark, [("e1", "x:1", "x:2", {"b": 2})]))
    return select.by_id(h.edges, "e1").select("id")



