"""The fixture graphs."""

from weftgraph.model import PropertyGraph, edge_rows, type_rows, vertex_rows


def social(spark) -> PropertyGraph:
    """Eight people, eight edges; two of them typed."""
    people = [("peiming", "t1", {"Name": "Peiming", "Age": "22", "Game": "Gal"}), ("yidong", "t1", {"Name": "Yidong", "Age": "21"}), ("weidong", None, {"Name": "Weidong", "Age": "22"})]
    people += [(n, None, {"Name": n, "Age": "21"}) for n in ("aaa", "bbb", "ccc", "ddd", "eee")]
    edges = [
        ("AE", "aaa", "eee", {"friend": 0.5}),
        ("PA", "peiming", "aaa", {"friend": 1}),
        ("AB", "aaa", "bbb", {"friend": 0.1}),
        ("BC", "bbb", "ccc", {"friend": 2}),
        ("YD", "yidong", "ddd", {"friend": 10}),
        ("PY", "peiming", "yidong", {"friend": None}),
        ("YP", "yidong", "peiming", {"friend": None}),
        ("PW", "peiming", "weidong", {"friend": None}),
    ]
    return PropertyGraph(vertex_rows(spark, people), edge_rows(spark, edges), type_rows(spark, [("t1", "Student", ["Name", "Num"])]))


def students(spark) -> PropertyGraph:
    """Three students in a chain of friends."""
    people = [("p", "t1", {"Name": "Peiming", "Age": "22", "Game": "Gal"}), ("y", "t1", {"Name": "Yidong", "Age": "21"}), ("w", "t1", {"Name": "Weidong", "Age": "22"})]
    edges = [("e1", "p", "y", {"relationship": "friend"}), ("e2", "y", "w", {"relationship": "friend"})]
    return PropertyGraph(vertex_rows(spark, people), edge_rows(spark, edges), type_rows(spark, [("t1", "Student", ["Name", "Num"])]))


def ids(frame, column="id"):
    return sorted(r[column] for r in frame.select(column).collect())
