"""One query for each operator of the graph engine over the driver's tables, and the SQL that states the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.attributes import EXISTS, MapAccess
from .model import PropertyGraph, VertexPattern, edge_rows, type_rows, union, vertex_rows
from .operators import mutate, pattern, select, traverse
from .operators.pattern import Condition, Hop
from .plans.scratch import root
from .plans.session import Session
from .registry import query
from .sources import storage
from .sources.tables import trade_graph

V = VertexPattern
BUILDING = V("customer", (("c_mktsegment", "BUILDING"),))
URGENT = V("order", (("o_orderpriority", "1-URGENT"),))


def whole(spark, d) -> PropertyGraph:
    """All vertices, edges and types in the map layout."""
    return trade_graph(spark, d).to_map_layout()


def _customers(g: PropertyGraph, frame: DataFrame | None = None) -> DataFrame:
    """Customer rows of a map-layout graph as plain columns."""
    frame = g.vertices if frame is None else frame
    a = MapAccess()
    return frame.select("id", "type_id", a.value("c_name")["s"].alias("c_name"), a.value("c_acctbal")["d"].alias("c_acctbal"), a.value("c_mktsegment")["s"].alias("c_mktsegment"))


VERTEX_SQL = " UNION ALL ".join(
    f"SELECT '{p}' || {k} AS id FROM {t}"
    for t, k, p in (("region", "r_regionkey", "r:"), ("nation", "n_nationkey", "n:"), ("customer", "c_custkey", "c:"), ("supplier", "s_suppkey", "s:"), ("part", "p_partkey", "p:"), ("orders", "o_orderkey", "o:"))
)


@query(VERTEX_SQL)
def vertex_scan(spark, d):
    return select.select_matching(trade_graph(spark, d), V())


@query("SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders")
def edge_scan_placed(spark, d):
    return pattern.edges_between(trade_graph(spark, d), V(), V(), (), "placed")


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS type_name, count(*) AS n FROM {t}" for n, t in (("region", "region"), ("nation", "nation"), ("customer", "customer"), ("supplier", "supplier"), ("part", "part"), ("order", "orders")))
)
def type_cardinality(spark, d):
    return select.type_counts(trade_graph(spark, d))


@query("SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) AS n_edges")
def edge_cardinality(spark, d):
    return union([e.frame.agg(F.count("*").alias("n")) for e in trade_graph(spark, d).edge_sets()]).agg(F.sum("n").alias("n_edges"))


@query("SELECT p_partkey, p_name FROM part")
def typed_scan(spark, d):
    (v,) = trade_graph(spark, d).vertex_sets("part")
    return v.frame.select("p_partkey", "p_name")


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_vertex_eq(spark, d):
    return select.select_matching(trade_graph(spark, d), BUILDING)


@query("SELECT 'p:' || p_partkey AS id FROM part WHERE p_size IS NOT NULL")
def select_vertex_exists(spark, d):
    return select.select_matching(trade_graph(spark, d), V("part", (("P_SIZE", EXISTS),)))


@query("SELECT 'c:' || c_custkey AS id, c_acctbal, row_number() OVER (ORDER BY c_acctbal NULLS FIRST, c_custkey) AS rk FROM customer")
def select_vertex_sorted(spark, d):
    (v,) = trade_graph(spark, d).vertex_sets("customer")
    return select.ranked(v.frame, v.access, "c_acctbal", "k").select(v.id.alias("id"), "c_acctbal", "rk")


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def select_vertex_predicate(spark, d):
    return select.select_matching(trade_graph(spark, d), BUILDING, lambda a: a.number("c_acctbal") > 5000)


@query("SELECT 'p:' || p_partkey AS id FROM part WHERE p_type = 'PROMO' AND p_size = 10")
def select_vertex_multi_kv(spark, d):
    return select.select_matching(trade_graph(spark, d), V("part", (("p_type", "PROMO"), ("p_size", 10))))


@query("SELECT 'p:' || p_partkey AS id FROM part WHERE false")
def select_vertex_strict_type(spark, d):
    return select.select_matching(trade_graph(spark, d), V("part", (("p_size", "10"),)))


@query("SELECT 'c:' || c_custkey AS id FROM customer WHERE c_name = 'Customer#000000007'")
def select_any_type(spark, d):
    return select.select_matching(trade_graph(spark, d), V(None, (("c_name", "Customer#000000007"),)))


@query("SELECT 'c:' || c_custkey AS id, c_name FROM customer WHERE c_custkey = 7")
def vertex_by_id(spark, d):
    (v,) = trade_graph(spark, d).vertex_sets("customer")
    return v.frame.where(F.col("k") == 7).select(v.id.alias("id"), "c_name")


@query("SELECT 's:' || s_suppkey AS id FROM supplier WHERE s_suppkey = 3")
def vertex_by_attribute(spark, d):
    g = trade_graph(spark, d)
    name = g.vertex_tables["supplier"].frame.where("s_suppkey = 3").select("s_name").first()[0]
    return select.select_matching(g, V("supplier", (("s_name", name),)))


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, l_linenumber FROM lineitem WHERE l_quantity = 10")
def select_edges_eq(spark, d):
    (e,) = trade_graph(spark, d).edge_sets("contains")
    return e.frame.where(e.access.equals("contains", 10.0)).select(e.src_id.alias("src"), e.dst_id.alias("dst"), "l_linenumber")


@query(
    "SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'"
)
def edges_between(spark, d):
    return pattern.edges_between(trade_graph(spark, d), BUILDING, URGENT)


def _condition(name: str, op: str, sql: str) -> None:
    def run(spark, d):
        return pattern.edges_between(trade_graph(spark, d), URGENT, V("part", (("p_size", 10),)), (Condition("contains", op, 30),))

    run.__name__ = name
    query(
        "SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey "
        f"WHERE o_orderpriority = '1-URGENT' AND p_size = 10 AND l_quantity {sql} 30"
    )(run)


for _n, _op in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("eq", "=")):
    _condition(f"edge_condition_{_n}", _op, _op)


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_quantity >= 40 AND l_discount < 0.02")
def edge_condition_conj(spark, d):
    return pattern.edges_between(trade_graph(spark, d), V("order"), V("part"), (Condition("contains", ">=", 40), Condition("l_discount", "<", 0.02)), "contains")


@query("SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) > 1")
def parallel_edges(spark, d):
    return select.parallel_pairs(trade_graph(spark, d), "supplies")


PAIR = "(SELECT l_suppkey AS ps, l_partkey AS pp FROM lineitem GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)"


@query(f"SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, l_quantity, row_number() OVER (ORDER BY l_quantity) AS rk FROM lineitem, {PAIR} WHERE l_suppkey = ps AND l_partkey = pp")
def parallel_edges_pair(spark, d):
    (e,) = trade_graph(spark, d).edge_sets("supplies")
    top = e.frame.groupBy("s", "d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "s", "d").first()
    pair = e.frame.where((F.col("s") == top.s) & (F.col("d") == top.d))
    return select.ranked(pair, e.access, "supplies", "l_orderkey").select(e.src_id.alias("src"), e.dst_id.alias("dst"), "l_quantity", "rk")


@query(
    "WITH e AS (SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey FROM lineitem) "
    "SELECT 'o:' || o_orderkey AS id, coalesce(i.n, 0) AS in_degree, coalesce(x.n, 0) AS out_degree, coalesce(i.n, 0) + coalesce(x.n, 0) AS degree FROM orders "
    "LEFT JOIN (SELECT dst, count(*) n FROM e GROUP BY 1) i ON i.dst = 'o:' || o_orderkey LEFT JOIN (SELECT src, count(*) n FROM e GROUP BY 1) x ON x.src = 'o:' || o_orderkey"
)
def degree(spark, d):
    return select.degrees(trade_graph(spark, d), "order", ["placed", "contains"])


@query("SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer WHERE c_custkey = 7")
def incident_edges(spark, d):
    g = trade_graph(spark, d)
    parts = [e.frame.where((F.col("s") == 7) if e.src_type == "customer" else F.lit(False)).select(e.src_id.alias("src"), e.dst_id.alias("dst")) for e in g.edge_sets() if e.src_type == "customer"]
    return union(parts)


@query("SELECT 'part' AS name, 'p_name,p_brand,p_type,p_size,p_retailprice' AS keys")
def type_by_name(spark, d):
    return select.type_by_name(_types(spark, d), "part").select("name", F.array_join("attr_order", ",").alias("keys"))


@query("SELECT * FROM (VALUES ('customer'), ('supplier')) t(name) WHERE name = 'customer'")
def types_with_attrs(spark, d):
    return select.types_with_attributes(_types(spark, d), ["c_name", "C_ACCTBAL"]).select("name")


def _types(spark, d) -> PropertyGraph:
    g = trade_graph(spark, d)
    return PropertyGraph(vertex_rows(spark, []), edge_rows(spark, []), type_rows(spark, [(n, n, list(t.attributes)) for n, t in g.vertex_tables.items()]))


MATCH_SQL = (
    "SELECT DISTINCT 'p:' || p_partkey AS id FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey "
    "WHERE p_size = 10 AND o_orderpriority = '1-URGENT' AND c_mktsegment = 'BUILDING'"
)
MATCH = 'select m from vertex(type(name:"part"),p_size:10) match vertex(type(name:"customer"),c_mktsegment:"BUILDING")-[placed]->vertex(type(name:"order"),o_orderpriority:"1-URGENT")-[contains]->m.'


@query(MATCH_SQL)
def match_path(spark, d):
    return Session(trade_graph(spark, d), strict=False).query(MATCH)


@query(
    "SELECT 's:' || s_suppkey AS id FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey = s_suppkey AND p_brand = 'Brand#12') "
    "AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_name IN (SELECT n_name FROM nation WHERE n_nationkey = 3))"
)
def match_star(spark, d):
    g = trade_graph(spark, d)
    name = g.vertex_tables["nation"].frame.where("n_nationkey = 3").select("n_name").first()[0]
    return pattern.match_star(g, V("supplier"), [Hop("supplies", V("part", (("p_brand", "Brand#12"),))), Hop("in_nation", V("nation", (("n_name", name),)))])


@query(
    "SELECT 'n:' || n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') "
    "UNION ALL SELECT 'o:' || o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
)
def match_any_hop(spark, d):
    return pattern.match_path(trade_graph(spark, d), BUILDING, [Hop(None, V())])


@query(
    "SELECT 'c:' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey "
    "WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND p_size = 10)"
)
def match_path_mode(spark, d):
    text = 'select m from vertex(type(name:"customer")) match m-[placed]->vertex(type(name:"order"),o_orderpriority:"1-URGENT")-[contains]->vertex(type(name:"part"),p_size:10).'
    return Session(trade_graph(spark, d), strict=False, star_as_path=True).query(text)


CONNECTED = "SELECT 'c:' || c_custkey AS src, 'r:' || r_regionkey AS dst FROM customer, region WHERE c_mktsegment = 'BUILDING'"


def _connected(spark, d, arrow: str) -> DataFrame:
    s = Session(whole(spark, d))
    s.execute(f'create edge vertex(c_mktsegment:"BUILDING")-[knows:3]{arrow}vertex(r_name:)')
    return select.select_edges(s.graph, "knows", 3).select("src", "dst")


@query(CONNECTED)
def create_edge_cross(spark, d):
    return _connected(spark, d, "->")


@query(f"WITH e AS ({CONNECTED}) SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def create_edge_bidir(spark, d):
    return _connected(spark, d, "-")


def _created(spark, d, statement: str, where: str) -> DataFrame:
    s = Session(whole(spark, d))
    s.execute(statement)
    frame = s.graph.vertices.where(where)
    return _customers(s.graph, frame).select("type_id", "c_name", "c_acctbal", "c_mktsegment")


BASE_CUSTOMERS = "SELECT 'customer' AS type_id, c_name, c_acctbal, c_mktsegment FROM customer"


@query(f"SELECT NULL AS type_id, 'New' AS c_name, 1.5::DOUBLE AS c_acctbal, 'NONE' AS c_mktsegment UNION ALL {BASE_CUSTOMERS}")
def create_vertex_kv(spark, d):
    return _created(spark, d, 'create vertex {c_name:"New", c_acctbal:1.5, c_mktsegment:"NONE"}', "type_id is null or type_id = 'customer'")


@query(f"SELECT 'customer' AS type_id, 'New one' AS c_name, NULL::DOUBLE AS c_acctbal, 'NONE' AS c_mktsegment UNION ALL {BASE_CUSTOMERS}")
def create_vertex_typed(spark, d):
    return _created(spark, d, 'create vertex {type(name:"customer"){c_name:"New one", c_mktsegment:"NONE"}}', "type_id = 'customer'")


@query(f"SELECT 'customer' AS type_id, 'New' AS c_name, -2.0::DOUBLE AS c_acctbal, 'NONE' AS c_mktsegment UNION ALL {BASE_CUSTOMERS}")
def create_vertex_positional(spark, d):
    return _created(spark, d, 'create vertex {type(name:"customer"){"New", -2.0, "NONE"}, go:"20"}', "type_id = 'customer'")


@query("SELECT * FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('order'), ('reviewer')) t(name)")
def create_type(spark, d):
    s = Session(whole(spark, d))
    s.execute('create type {name:"reviewer", stars, words}')
    return s.graph.types.select("name")


def _altered(spark, d, statement: str) -> DataFrame:
    s = Session(whole(spark, d))
    s.execute(statement)
    return _customers(s.graph).where("id LIKE 'c:%'")


ALTERED = "SELECT 'c:' || c_custkey AS id, {type} AS type_id, {name} AS c_name, {bal} AS c_acctbal, {seg} AS c_mktsegment FROM customer"
PLAIN = {"type": "'customer'", "name": "c_name", "bal": "c_acctbal", "seg": "c_mktsegment"}


@query(ALTERED.format(**PLAIN | {"seg": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END", "bal": "CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE c_acctbal END"}))
def alter_change(spark, d):
    return _altered(spark, d, 'alter vertex(c_mktsegment:"BUILDING") change {c_mktsegment:"HOUSING", c_acctbal:0.5}')


@query(ALTERED.format(**PLAIN | {"bal": "CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE c_acctbal END"}))
def alter_merge(spark, d):
    return _altered(spark, d, 'alter vertex(c_mktsegment:"BUILDING") merge {c_acctbal:0.5}')


@query(ALTERED.format(**PLAIN | {"type": "CASE WHEN c_mktsegment = 'BUILDING' THEN 'order' ELSE 'customer' END"}))
def alter_retype(spark, d):
    return _altered(spark, d, 'alter vertex(c_mktsegment:"BUILDING") change {type(name:"order"){"F"}}')


@query(ALTERED.format(**PLAIN | {"bal": "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END"}))
def alter_drop_attr(spark, d):
    return _altered(spark, d, 'alter delete vertex(c_mktsegment:"BUILDING") change {c_acctbal}')


EDGES = {
    "in_region": "SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst FROM nation",
    "in_nation": "SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst FROM customer UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier",
    "placed": "SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders",
    "contains": "SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem",
    "supplies": "SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem",
}
EDGE_SQL = " UNION ALL ".join(EDGES.values())


@query(f"SELECT src, dst FROM ({EDGE_SQL}) WHERE src NOT IN (SELECT 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_vertex_cascade(spark, d):
    s = Session(whole(spark, d))
    s.execute('alter delete vertex(c_mktsegment:"BUILDING")')
    return s.graph.edges.select("src", "dst")


@query(
    f"SELECT src, dst FROM ({EDGE_SQL}) WHERE NOT (src IN (SELECT 'c:' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND dst IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))"
)
def delete_edge(spark, d):
    s = Session(whole(spark, d))
    s.execute('alter delete edge(vertex(c_mktsegment:"BUILDING"), vertex(o_orderpriority:"1-URGENT"), placed)')
    return s.graph.edges.select("src", "dst")


TABLE_OF = {"region": ("region", "r_regionkey", "r:"), "nation": ("nation", "n_nationkey", "n:"), "customer": ("customer", "c_custkey", "c:"), "supplier": ("supplier", "s_suppkey", "s:"), "part": ("part", "p_partkey", "p:"), "order": ("orders", "o_orderkey", "o:")}
TYPE_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS t, count(*) AS n FROM {t}" for n, (t, _, _) in TABLE_OF.items())
MEMBERS = " UNION ALL ".join(f"SELECT '{p}' || {k} AS id, '{n}' AS type_id FROM {t}" for n, (t, k, p) in TABLE_OF.items())


@query(f"SELECT nullif(t, 'customer') AS type_id, n FROM ({TYPE_COUNTS})")
def delete_type(spark, d):
    s = Session(whole(spark, d))
    s.execute('alter delete type(name:"customer")')
    return s.graph.vertices.groupBy("type_id").agg(F.count("*").alias("n"))


@query(f"SELECT replace(t, 'customer', 'client') AS type_name, n FROM ({TYPE_COUNTS})")
def rename_type(spark, d):
    s = Session(whole(spark, d))
    s.execute('alter type(name:"customer") change {"client"}')
    return select.type_counts(s.graph)


@query("SELECT 'c:' || c_custkey AS id, c_mktsegment AS branch FROM customer")
def rename_attr(spark, d):
    s = Session(whole(spark, d))
    s.execute('alter type(name:"customer") change {c_mktsegment:branch}')
    return select.select_vertices(s.graph, "branch").select("id", MapAccess().value("branch")["s"].alias("branch"))


@query(VERTEX_SQL)
def bulk_add_rejects(spark, d):
    """All vertices there are and a new one are offered; all but that one are rejected."""
    g = whole(spark, d)
    new = g.vertices.select("id", "type_id", "attrs").unionByName(vertex_rows(spark, [("x:1", None, {"a": 1})]).select("id", "type_id", "attrs"))
    return mutate.add_vertices(g, new)[1].select("id")


@query("SELECT 'c:1' AS src, 'o:missing' AS dst")
def add_edges_rejects(spark, d):
    g = whole(spark, d)
    new = edge_rows(spark, [("e1", "c:1", "o:missing", {}), ("e2", "c:1", "c:2", {"knows": 3})])
    return mutate.add_edges(g, new)[1].select("src", "dst")


def _supplies(spark, d, where: str | None = None) -> DataFrame:
    """(src, dst, w): supplies, both ways; parallel edges come each."""
    (e,) = trade_graph(spark, d).edge_sets("supplies")
    there = (e.frame.where(where) if where else e.frame).select(e.src_id.alias("src"), e.dst_id.alias("dst"), F.col("l_quantity").alias("w"))
    return there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


# The table that USING KEY keeps lets the recursions end by themselves, however many hops there are.
WALK = """
walk(v, h) USING KEY (v) AS (SELECT 's:0', 0
  UNION SELECT e.dst, min(walk.h) + 1 FROM walk JOIN e ON walk.v = e.src WHERE {stop} e.dst NOT IN (SELECT v FROM recurring.walk) GROUP BY e.dst),
pred AS (SELECT b.v, min(a.v) AS p FROM walk a JOIN e ON e.src = a.v JOIN walk b ON b.v = e.dst AND b.h = a.h + 1 GROUP BY b.v),
back(v, h) AS (SELECT v, h FROM walk WHERE v = '{target}' UNION ALL SELECT p.p, back.h - 1 FROM back JOIN pred p ON p.v = back.v)
"""
BFS_SQL = (
    """
WITH RECURSIVE e AS (
  SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_quantity = 1
  UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem WHERE l_quantity = 1),"""
    + WALK.format(stop="", target="s:50")
)


@query(BFS_SQL + "SELECT v AS vertex_id, h::INT AS hops FROM walk")
def bfs_distance(spark, d):
    return traverse.bfs_levels(_supplies(spark, d, "l_quantity = 1"), "s:0").select(F.col("v").alias("vertex_id"), F.col("h").alias("hops"))


@query(BFS_SQL + "SELECT h::INT AS step, v AS vertex_id FROM back")
def bfs_path(spark, d):
    return traverse.shortest_path(_supplies(spark, d, "l_quantity = 1"), "s:0", "s:50")


@query(BFS_SQL + "SELECT ((SELECT max(h) FROM back) - h)::INT AS step, v AS vertex_id FROM back")
def bfs_path_reversed(spark, d):
    return traverse.shortest_path(_supplies(spark, d, "l_quantity = 1"), "s:0", "s:50", forward=False)


PREDICATE_SQL = (
    """
WITH RECURSIVE f AS (
  SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_quantity <= 5
  UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem WHERE l_quantity <= 5),
e AS (SELECT * FROM f WHERE dst LIKE 's:%' OR dst IN (SELECT 'p:' || p_partkey FROM part WHERE p_size <= 10)),"""
    + WALK.format(stop="walk.v <> 's:5' AND", target="s:5")
)


@query(PREDICATE_SQL + "SELECT h::INT AS step, v AS vertex_id FROM back")
def bfs_path_predicate(spark, d):
    g = trade_graph(spark, d)
    inner = select.select_matching(g, V("part"), lambda a: a.number("p_size") <= 10).unionByName(select.select_matching(g, V("supplier")))
    return traverse.shortest_path(_supplies(spark, d, "l_quantity <= 5"), "s:0", "s:5", allowed=inner)


@query(
    """
WITH RECURSIVE e AS (
  SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, min(l_quantity) AS w FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, min(l_quantity) FROM lineitem GROUP BY 1, 2),
walk(v, d) AS (SELECT dst, w FROM e WHERE src = 's:0' AND w <= 5
  UNION SELECT e.dst, walk.d + e.w FROM walk JOIN e ON v = e.src WHERE walk.d + e.w <= 5)
SELECT v AS vertex_id, min(d) AS distance FROM walk GROUP BY v
"""
)
def nearby(spark, d):
    return traverse.nearby(_supplies(spark, d), "s:0", 5.0)


@query("SELECT 'n:' || n_nationkey AS id, 'n_name : ' || n_name || ' ' || chr(10) AS text FROM nation")
def attrs_to_string(spark, d):
    g = trade_graph(spark, d)
    wide = type(g)({"nation": g.vertex_tables["nation"]}, {"in_region": []})
    vertices = wide.vertex_sets()[0]
    attrs = F.map_from_arrays(F.array(F.lit("n_name")), F.array(F.struct(F.lit("string").alias("t"), F.col("n_name").alias("s"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b"))))
    return vertices.frame.select(vertices.id.alias("id"), select.attributes_as_text(attrs).alias("text"))


@query(
    "SELECT 'c:' || c_custkey || ' 3 c_acctbal ' || CASE WHEN c_acctbal = floor(c_acctbal) THEN printf('%.1f', c_acctbal) ELSE c_acctbal::VARCHAR END || ' c_mktsegment ''' || c_mktsegment || ''' c_name ''' || replace(c_name, ' ', '%20') || '''' AS line FROM customer "
    "UNION ALL SELECT 'r:' || r_regionkey || ' 1 r_name ''' || replace(r_name, ' ', '%20') || '''' FROM region UNION ALL SELECT 'n:' || n_nationkey || ' 1 n_name ''' || replace(n_name, ' ', '%20') || '''' FROM nation"
)
def export_vertex_lines(spark, d):
    g = whole(spark, d)
    return storage.vertex_lines(PropertyGraph(g.vertices.where("type_id IN ('customer', 'region', 'nation')"), g.edges, g.types)).select(F.col("value").alias("line"))


def copied(spark, d) -> PropertyGraph:
    """The whole graph, written as text and read back."""
    path = f"{root(spark)}/weftgraph-text-{uuid.uuid4().hex}"
    storage.export_text(whole(spark, d), path)
    return storage.import_text(spark, path)


@query("SELECT 'c:' || c_custkey AS id, 'customer' AS type_id, c_name, c_acctbal, c_mktsegment FROM customer")
def roundtrip(spark, d):
    return _customers(copied(spark, d)).where("id LIKE 'c:%'")


@query(MEMBERS)
def roundtrip_members(spark, d):
    return copied(spark, d).vertices.select("id", "type_id")


@query("SELECT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst, l_quantity, l_linenumber::BIGINT AS l_linenumber FROM lineitem")
def roundtrip_edges(spark, d):
    a = MapAccess()
    edges = select.select_edges(copied(spark, d), "contains")
    return edges.select("src", "dst", a.value("l_quantity")["d"].alias("l_quantity"), a.value("l_linenumber")["i"].alias("l_linenumber"))
