"""Every registered graph query against its SQL, and the two layouts against each other."""

import duckdb
import pytest

import __spark_entry__ as entry
from weftgraph.registry import ORACLE, QUERIES
from weftgraph.model import EXISTS, VertexPattern
from weftgraph.operators import pattern, select
from weftgraph.operators.pattern import Condition, Hop
from weftgraph.plans.scratch import written
from weftgraph.sources.tables import trade_graph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, data, duck, name):
    frame = QUERIES[name](spark, data)
    got = sorted(tuple(shown(r[c]) for c in sorted(frame.columns)) for r in frame.collect())
    sql = duck.sql(ORACLE[name])
    assert sorted(sql.columns) == sorted(frame.columns)
    want = sorted(tuple(shown(dict(zip(sql.columns, r, strict=True))[c]) for c in sorted(sql.columns)) for r in sql.fetchall())
    assert got == want


def test_every_graph_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["id"] and frame.count() == 3


def test_layouts_agree(spark, data):
    wide = trade_graph(spark, data)
    flat = wide.to_map_layout()
    flat = type(flat)(written(flat.vertices), written(flat.edges), flat.types)
    V = VertexPattern
    building, urgent, ten = V("customer", (("c_mktsegment", "BUILDING"),)), V("order", (("o_orderpriority", "1-URGENT"),)), V("part", (("p_size", 10),))
    cases = [
        lambda g: select.select_matching(g, building),
        lambda g: select.select_matching(g, V(None, (("c_acctbal", EXISTS),))),
        lambda g: select.select_matching(g, V("part", (("p_size", "10"),))),
        lambda g: pattern.match_path(g, building, [Hop("placed", urgent), Hop("contains", ten)]),
        lambda g: pattern.match_path(g, V("supplier"), [Hop(None, V("nation"))]),
        lambda g: pattern.match_star(g, V("customer"), [Hop("placed", urgent), Hop("in_nation", V("nation"))]),
        lambda g: pattern.match_chain(g, V("customer"), [Hop("placed", urgent), Hop("contains", ten)]),
        lambda g: pattern.edges_between(g, urgent, ten, (Condition("contains", ">", 30), Condition("l_discount", "<=", 0.05))),
        lambda g: select.degrees(g, "nation"),
        lambda g: select.parallel_pairs(g, "supplies"),
    ]
    for case in cases:
        assert sorted(map(tuple, case(wide).collect())) == sorted(map(tuple, case(flat).collect()))


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = lambda name: QUERIES[name](spark, data)._jdf.queryExecution().toString()
    found = plan("select_vertex_eq")
    assert "EqualTo(c_mktsegment,BUILDING)" in found and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in found
    found = plan("match_path")
    assert "CartesianProduct" not in found and "BroadcastNestedLoopJoin" not in found
    assert "EqualTo(o_orderpriority,1-URGENT)" in found and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in found
