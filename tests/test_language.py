import pytest

from tests.graphs import ids, students
from weftgraph.functions.attributes import EXISTS
from weftgraph.plans import syntax as S
from weftgraph.plans.parser import GraphQueryError, parse
from weftgraph.plans.session import Session

STUDENT = 'vertex(type(name:"Student")'


@pytest.fixture
def session(spark):
    return Session(students(spark))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f'select v from {STUDENT},Age:"22").', ["p", "w"]),
        (f'select m from {STUDENT}) match {STUDENT},Name:"Peiming")-[relationship]->m.', ["y"]),
        (f'select m from {STUDENT}) match m-[relationship]->{STUDENT},Name:"Weidong").', ["y"]),
        (f'select m from {STUDENT}) match {STUDENT},Name:"Peiming")-[relationship]->{STUDENT})-[relationship]->m.', ["w"]),
        (f'select m from {STUDENT}) match {STUDENT},Name:"Peiming")-[]->m.', ["y"]),
        ('select v from vertex(type(name:"null"),Game:"Gal").', ["p"]),
        ("select v from vertex(game:).", ["p"]),
    ],
)
def test_selects(session, text, found):
    assert ids(session.query(text)) == found


def test_star_and_chain_differ(spark):
    text = f"select m from {STUDENT}) match m-[relationship]->{STUDENT})-[relationship]->{STUDENT})."
    assert ids(Session(students(spark)).query(text)) == ["p", "y"]
    assert ids(Session(students(spark), star_as_path=True).query(text)) == ["p"]


def test_edges_and_types(session):
    (r,) = session.execute(f'select e from edge({STUDENT},Name:"Peiming"),{STUDENT},Name:"Yidong"))')
    assert r.kind == "edge" and [tuple(x) for x in r.frame.collect()] == [("p", "y")]
    assert ids(session.query('select t from type(name:"Student")')) == ["t1"]
    assert ids(session.query("select t from type(Name, Num)")) == ["t1"]
    session.execute('create edge vertex(Name:"Peiming")-[weight:5]->vertex(Name:"Yidong") create edge vertex(Name:"Peiming")-[weight:2.5]->vertex(Name:"Yidong")')
    both = f"select e from edge({STUDENT}),{STUDENT}), weight"
    assert [session.query(f"{both}{c})").count() for c in (">2", "<=2.5", ">= 5", "<5, weight>2", "=5", "< = 2.5", ">9")] == [2, 1, 1, 1, 1, 1, 0]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ('alter vertex(Name:"Weidong") merge {Height:180}', 1),
        ('alter delete vertex(Name:"Nobody")', 2),
        ("alter delete vertex(abc-1)", 2),
        ('alter delete vertex(Name:"Nobody") change {Age}', 2),
        ('alter delete type(name:"Nope")', 3),
        ('select v from vertex(type(name:"Nope")).', 3),
        ('alter delete edge(vertex(Name:"Peiming"), vertex(Name:"Weidong"), relationship)', 4),
        ('alter type(name:"Student") change {Nope:x}', 5),
        ('create vertex {type(name:"Student"){"a","b","c"}}', 5),
        ('alter type(name:"Student") change {Num:Age}', 6),
        ('select v from vertex(type(name:"Student"),Age:"99").', 7),
        ("drop everything", 0),
        ("create vertex {a:b}", 0),
        ('select v from vertex(type("TypeName"), Attr > Value )', 0),
        ('alter delete edge(vertex(a:"1"),vartex(b:"2"),k)', 0),
        ('create type{name:"T"}', 0),
        ("", None),
    ],
)
def test_errors_change_nothing(session, text, code):
    before = session.graph
    if code is None:
        assert session.execute(text) == []
        return
    with pytest.raises(GraphQueryError) as e:
        session.execute(text)
    assert e.value.code == code and session.graph is before


def test_first_error_stops_the_batch(session):
    with pytest.raises(GraphQueryError) as e:
        session.execute('create vertex {a:1} ; alter delete vertex(Name:"Nobody") create vertex {a:2}')
    assert e.value.statement == 1 and session.graph.vertices.count() == 4


def test_changes(session):
    session.execute('alter vertex(Name:"Weidong") merge {Age:"23"}')
    assert ids(session.query(f'select v from {STUDENT},Age:"23").')) == ["w"]
    session.execute('alter vertex(Age:"22") change {Height:-180, Note:"two words"}')
    assert ids(session.query('select v from vertex(height:-180,note:"two words").')) == ["p"]
    session.execute('create vertex {type(name:"Student"){"Ann", 7}, go:"20"} create vertex {type(name:"Student"){Name:"Bob"}}')
    assert session.query(f'select v from {STUDENT},num:7,go:"20").').count() == 1
    session.execute('create edge vertex(Age:"22")-[knows:3]->vertex(Age:"21")')
    assert session.graph.edges.count() == 3
    session.execute('create edge vertex(Name:"Peiming")-[knows]-vertex(Name:"Weidong")')
    assert session.graph.edges.count() == 5
    session.execute('alter delete edge(vertex(Name:"Peiming"), vertex(Name:"Weidong"), nope, knows)')
    assert session.graph.edges.count() == 4
    session.execute('alter type(name:"Student") change {"Pupil", Num:Number}')
    assert session.query('select v from vertex(type(name:"Pupil"),number:7).').count() == 1
    session.execute('create type {name:"Teacher", subject} alter vertex(Name:"Bob") change {type(name:"Teacher"){"maths"}}')
    assert session.query('select v from vertex(type(name:"Teacher"),subject:"maths").').count() == 1
    session.execute('alter delete vertex(Name:"Bob") change {subject} alter delete vertex(p) alter delete type(t1)')
    assert session.graph.edges.where("src = 'p' or dst = 'p'").count() == 0
    assert session.graph.types.count() == 1


def test_duplicate_type_names_are_ignored_and_renames_refused(session):
    session.execute('create type {name:"Student", a} create type {name:"Other", a}')
    assert session.graph.types.count() == 2
    with pytest.raises(GraphQueryError):
        session.execute('alter type(name:"Other") change {"Student"}')


def test_parser_forms():
    assert parse('create vertex {name:"pei \\"x\\"",game:,age:22,h:-1.5}')[0].attrs == {"name": 'pei "x"', "game": None, "age": 22, "h": -1.5}
    assert parse("CREATE EDGE Vertex(a:1)-[b,c:2]-vertex(d:)")[0] == S.CreateEdge(S.Ref("a", 1), S.Ref("d", EXISTS), {"b": None, "c": 2}, True)
    assert [type(x) for x in parse("create vertex {a:1}create vertex {b:2};select t from type(a)")] == [S.CreateVertex, S.CreateVertex, S.SelectTypes]
    assert parse("alter delete vertex(0a1b-22-c3)")[0].id == "0a1b-22-c3"
    assert parse("create vertex {a:99999999999}")[0].attrs == {"a": 99999999999}
