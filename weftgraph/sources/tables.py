"""The driver's tables as a wide-layout property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import EdgeTable, VertexTable, WideGraph


def trade_graph(spark: SparkSession, sf_dir: str) -> WideGraph:
    """Vertices region, nation, customer, supplier, part, order; edges in_region, in_nation, placed, contains, supplies."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    vertices = {
        "region": VertexTable(t["region"], "r_regionkey", "r:", ("r_name",)),
        "nation": VertexTable(t["nation"], "n_nationkey", "n:", ("n_name",)),
        "customer": VertexTable(t["customer"], "c_custkey", "c:", ("c_name", "c_acctbal", "c_mktsegment")),
        "supplier": VertexTable(t["supplier"], "s_suppkey", "s:", ("s_name", "s_acctbal")),
        "part": VertexTable(t["part"], "p_partkey", "p:", ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
        "order": VertexTable(t["orders"], "o_orderkey", "o:", ("o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")),
    }
    edges = {
        "in_region": [EdgeTable(t["nation"], "nation", "n_nationkey", "region", "n_regionkey")],
        "in_nation": [EdgeTable(t["customer"], "customer", "c_custkey", "nation", "c_nationkey"), EdgeTable(t["supplier"], "supplier", "s_suppkey", "nation", "s_nationkey")],
        "placed": [EdgeTable(t["orders"], "customer", "o_custkey", "order", "o_orderkey", {"placed": "o_totalprice"})],
        "contains": [
            EdgeTable(t["lineitem"], "order", "l_orderkey", "part", "l_partkey", {"contains": "l_quantity", **{c: c for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")}})
        ],
        "supplies": [EdgeTable(t["lineitem"], "supplier", "l_suppkey", "part", "l_partkey", {"supplies": "l_quantity"})],
    }
    return WideGraph(vertices, edges)
