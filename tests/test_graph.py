import pytest
from pyspark.sql import functions as F

from lodestrata import schema as S
from lodestrata.operators import enrich as E
from lodestrata.operators import graph_build as B
from lodestrata.operators import graph_query as Q
from lodestrata.operators import traverse as V

NODES = "id long, label string, name string, qualified_name string, file_path string, line_start int, line_end int, properties map<string,string>"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame(
        [(k, "Function" if k < 7 else "Class", f"n{k}", f"p::f.py::n{k}", "f.py", k, k + 1, {}) for k in range(1, 9)] + [(9, "Function", "main", "p::f.py::main", None, 0, 0, None)], NODES
    )
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1), (5, 6), (7, 7)]
    return nodes, spark.createDataFrame([(a, b, "CALLS", 0.9, {}, k) for k, (a, b) in enumerate(edges)], S.EDGE)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search(graph):
    nodes, edges = graph
    assert ids(Q.search_nodes(nodes, edges, query="N1")) == [1]
    assert ids(Q.search_nodes(nodes, edges, label="Class")) == [7, 8]
    assert ids(Q.search_nodes(nodes, edges, name_pattern="n[12]$")) == [1, 2]
    assert len(ids(Q.search_nodes(nodes, edges, name_pattern="("))) == 9
    assert ids(Q.search_nodes(nodes, edges, file_path="f.", limit=2)) == [1, 2]
    assert ids(Q.search_nodes(nodes, edges, max_degree=0, exclude_entry_points=True)) == [8]
    assert ids(Q.search_nodes(nodes, edges, max_degree=2, label="Class")) == [7, 8]
    assert ids(Q.search_nodes(nodes, edges, relationship="HANDLES")) == []
    assert ids(Q.dead_code(nodes, edges)) == [8]


def test_neighbours(graph):
    nodes, edges = graph
    assert ids(Q.callers(nodes, edges, "p::f.py::n4")) == [2, 3]
    assert ids(Q.callees(nodes, edges, "p::f.py::n1")) == [2, 3]
    assert ids(Q.callers(nodes, edges, "none")) == []


def test_fan(graph, spark):
    nodes, edges = graph
    start = spark.createDataFrame([(1,)], "id long")
    got = {r.id: (r.depth, r.via and r.via.source_id) for r in V.trace_fan(edges, start, "outbound", 9).collect()}
    assert got == {1: (0, None), 2: (1, 1), 3: (1, 1), 4: (2, 2), 5: (3, 4), 6: (4, 5)}
    assert {r.id: r.depth for r in V.trace_fan(edges, start, "inbound", 2).collect()} == {1: 0, 5: 1, 4: 2}
    assert {r.id for r in V.trace_fan(edges, start, "both", 1).collect()} == {1, 2, 3, 5}
    assert V.trace_fan(edges, start, "outbound", 0).count() == 1
    with pytest.raises(ValueError):
        V.trace_fan(edges, start, "sideways")


def test_path(graph, spark):
    _, edges = graph
    node = lambda k: spark.createDataFrame([(k,)], "id long")
    walk = lambda a, b, n=5: [r.id for r in V.trace_path(edges, node(a), node(b), n).orderBy("depth").collect()]
    assert walk(1, 6) == [1, 2, 4, 5, 6]
    assert walk(1, 6, 3) == [] and walk(6, 1) == [] and walk(1, 99) == [] and walk(99, 1) == []
    assert walk(1, 1) == [1, 2, 4, 5, 1] and walk(7, 7) == [7, 7]


def test_start_and_body(graph, spark):
    nodes, edges = graph
    assert ids(V.resolve_start(nodes, "n3")) == [3] and ids(V.resolve_start(nodes, "N")) == [9] and ids(V.resolve_start(nodes, "zz")) == []
    files = spark.createDataFrame([("f.py", "\n".join(f"l{k}" for k in range(1, 12)))], "rel_path string, content string")
    got = {r.id: r.body for r in V.trace_fan_with_body(nodes, edges, "n4", "outbound", 1, files).collect()}
    assert got == {4: "l4\nl5", 5: "l5\nl6"}
    assert [tuple(r) for r in Q.snippet(nodes, files, "p::f.py::n2", 1).collect()] == [("p::f.py::n2", "f.py", 1, 4, "py", "l1\nl2\nl3\nl4")]


def test_upsert_and_merge(spark):
    rows = spark.createDataFrame(
        [("q", "File", "a", "f", 1, 2, {"x": "1", "y": "1"}, 1), ("q", "Class", "b", None, 3, 4, {"y": "2"}, 2), ("r", "File", "c", "g", 0, 0, None, 3)],
        "qualified_name string, label string, name string, file_path string, line_start int, line_end int, properties map<string,string>, ord long",
    )
    got = {r.qualified_name: r for r in B.upsert_nodes(rows).collect()}
    assert (got["q"].label, got["q"].file_path, got["q"].ord, got["q"].properties) == ("Class", None, 1, {"x": "1", "y": "2"}) and got["r"].properties == {}
    edges = spark.createDataFrame([(1, 2, "CALLS", None, {"a": "1"}, 5), (1, 2, "CALLS", 0.5, {"a": "2"}, 6), (1, 2, "USES", None, None, 7)], S.EDGE)
    got = {r.edge_type: (r.confidence, r.ord, r.properties) for r in B.merge_edges(edges).collect()}
    assert got == {"CALLS": (0.5, 5, {"a": "2"}), "USES": (None, 7, {})}
    both = B.merge_graphs(B.upsert_nodes(rows), B.upsert_nodes(rows.filter("qualified_name = 'r'").withColumn("name", F.lit("new"))))
    assert {r.qualified_name: r.name for r in both.collect()} == {"q": "b", "r": "new"}
    changed = B.set_node_property(B.upsert_nodes(rows), "q", "x", "9")
    assert {r.qualified_name: r.properties for r in changed.collect()}["q"] == {"x": "9", "y": "2"}


def test_resolution_strategies(spark):
    defs = spark.createDataFrame([("p::a.py::run", "run", 1), ("p::b/c.py::run", "run", 2), ("p::b/d.py::run", "run", 3), ("p::b/c.py::only", "only", 4), ("p::a.pyx::solo", "solo", 5), ("p::z.py::solo", "solo", 6)], "qualified_name string, simple_name string, ord long")
    imports = spark.createDataFrame([("m.py", "b.c", None, ["run"], 1), ("n.py", "zzz", None, ["run"], 1)], "rel_path string, module_path string, alias string, names array<string>, ord long")
    calls = spark.createDataFrame(
        [(1, "p", "m.py", "run", None), (2, "p", "a.py", "run", "p::a.py::f"), (3, "p", "x.py", "only", None), (4, "p", "b/q.py", "run", "p::b/q.py::g"), (5, "p", "x.py", "gone", None), (6, "p", "a.py", "solo", "p::a.py::f")],
        "call_id long, project string, rel_path string, callee string, caller_qn string",
    )
    got = {r.call_id: (r.target_qn, r.confidence) for r in B.resolve_calls(calls, defs, imports).collect()}
    assert got == {1: ("p::b/c.py::run", 0.95), 2: ("p::a.py::run", 0.9), 3: ("p::b/c.py::only", 0.75), 4: ("p::b/d.py::run", 0.55), 6: ("p::a.pyx::solo", 0.55)}
    strict = {r.call_id: r.confidence for r in B.resolve_calls(calls, defs, imports, strict_imports=True).collect()}
    assert strict[1] == 0.55


def test_routes(spark):
    rows = [(1, "list", "a.py", "/x", "GET,POST"), (2, "get_user_names", "app/views.py", None, None), (3, "GET", "src/app/(g)/users/[id]/[...rest]/route.ts", None, None), (4, "get_x", "lib/a.py", None, None), (5, "post", "pages/api/+server.ts", None, None)]
    got = sorted(tuple(r) for r in E.routes(spark.createDataFrame(rows, "id long, name string, file_path string, route_path string, route_method string")).collect())
    assert got == [(1, "GET", "/x"), (1, "POST", "/x"), (2, "GET", "/user/names"), (3, "GET", "/users/:id/*rest"), (5, "POST", "/")]


def test_tests_and_similar_names(spark):
    paths = ["src/a.py", "tests/test_a.py", "b.ts", "b.spec.ts", "lib/c.js", "tests/c.js", "d_test.py", "test_e.py"]
    got = {r.test_path: r.impl_path for r in E.test_links(spark.createDataFrame(list(enumerate(paths)), "ord long, path string")).collect()}
    assert got == {"tests/test_a.py": "src/a.py", "b.spec.ts": "b.ts", "tests/c.js": "lib/c.js"}
    nodes = spark.createDataFrame([(1, "Function", "Run", "a"), (2, "Method", "test_run", "b"), (3, "Function", "run", "a"), (4, "Class", "run", "c")], "id long, label string, name string, file_path string")
    assert sorted((r.a, r.b) for r in E.similar_names(nodes).collect()) == [(1, 2), (2, 3)]


def test_co_changes(spark):
    rows = [(c, p) for c in range(3) for p in "ab"] + [(3, "a"), (4, "c"), (4, "a")] + [(9, str(k)) for k in range(25)] + [(9, "a"), (9, "b")]
    got = [tuple(r) for r in E.co_changes(spark.createDataFrame(rows, "commit_id long, path string")).collect()]
    assert got == [("a", "b", 3, 1.0)]


def test_changes(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 2, 2), ("n", 1, 1)], "rel_path string, mtime_s long, size long")
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 3), ("z", 1, 1)], "rel_path string, mtime_s long, size long")
    assert {r.rel_path: r.status for r in Q.detect_changes(a, b).collect()} == {"y": "modified", "n": "added", "z": "deleted"}
