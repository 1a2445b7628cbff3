import ast
import gc
import subprocess
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.api import Workbench
from lodestrata.plans.index import build_graph
from lodestrata.sources import extract as X
from lodestrata.sources import files as S
from lodestrata.streaming import watch as W

FILES = {
    "src/users.py": "import os\nfrom src.store import save as keep, load\n\n@app.get('/users')\ndef list_users():\n    return load()\n\nclass Users:\n    def add(self, x):\n        self.check(x)\n        return load(x)\n    def check(self, x):\n        def inner(): pass\n        inner()\n\n@app.route('/u', methods=['GET', 'POST'])\nasync def both(): pass\n",
    "src/store.py": "def load(): pass\ndef save(): load()\ndef unused(): pass\n",
    "tests/test_users.py": "def test_add(): list_users()\n",
    "src/broken.py": "def x(:\n",
    "web/app.js": "const { a, b } = require('./lib');\nimport d, { e as f } from 'mod';\nfunction start(x) { a(x); return go(b()); }\nclass Box { open() { start(1); } get(k) { return this.m[k]; } }\napp.get('/things', listThings);\napp.post(\"/things\", box.open);\nfunction listThings(req) {}\nconst s = `function no() {`; // function comment() {}\n",
    "src/__init__.py": "from . import users\n", "web/api.ts": "interface Shape { area(): number }\nexport enum Kind { A }\ntype Alias = string;\nexport class Ctl {\n  @Get('/n')\n  one(x: string): void { helper(x); }\n  @Post()\n  async two() {}\n}\nexport function helper<T>(x: T) {}\n",
    "app/users/[id]/route.ts": "export async function GET() {}\n",
    "node_modules/x/y.js": "function hidden() {}", "ignored/z.py": "def z(): pass", "a.txt": "no", "lib.min.js": "function m(){}", ".gitignore": "ignored/\n*.log\n",
}


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos") / "shop"
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def bench(spark, repo, tmp_path_factory):
    found = Workbench(spark, f"file://{tmp_path_factory.mktemp('cache')}")
    commits = spark.createDataFrame([(c, p) for c in range(3) for p in ("src/users.py", "src/store.py")], "commit_ord long, path string")
    told = found.index_repository(str(repo), commits=commits)
    assert told["indexed"] and told["errors"] == 1
    return found


def test_discovery(spark, repo):
    got = {r.rel_path: r.language for r in S.discover(spark, str(repo)).collect()}
    assert got == {"src/__init__.py": "Python", "src/users.py": "Python", "src/store.py": "Python", "tests/test_users.py": "Python", "src/broken.py": "Python", "web/app.js": "JavaScript", "web/api.ts": "TypeScript", "app/users/[id]/route.ts": "TypeScript", "lib.min.js": "JavaScript"}
    assert "lib.min.js" not in {r.rel_path for r in S.discover(spark, str(repo), "fast").collect()}
    assert "ignored/z.py" in {r.rel_path for r in S.discover(spark, str(repo), gitignore=False).collect()}


@pytest.mark.parametrize(
    ("line", "base", "path", "hit"),
    [("*.log", "", "a/b.log", True), ("/x", "", "a/x", False), ("/x", "", "x/y", True), ("a/**/b", "", "a/q/r/b", True), ("d/", "", "d", False), ("d/", "", "e/d/f", True), ("f?.py", "s", "s/f1.py", True), ("f?.py", "s", "f1.py", False), ("[ab].c", "", "b.c", True)],
)
def test_ignore_patterns(line, base, path, hit):
    import re

    assert bool(re.search(S.ignore_regex(line, base)[0], path)) == hit
    assert S.ignore_regex("# c") is None and S.ignore_regex("!keep")[1]


def test_python_extraction():
    found = X.extract(FILES["src/users.py"], "Python", "p", "u.py")
    assert [(d[0], d[2]) for d in found.definitions] == [("list_users", "Function"), ("Users", "Class"), ("add", "Method"), ("check", "Method"), ("inner", "Function"), ("both", "Function")]
    assert found.definitions[4][1] == "p::u.py::Users.check.inner"
    assert [(c[0], c[2]) for c in found.calls] == [("load", "p::u.py::list_users"), ("check", "p::u.py::Users.add"), ("load", "p::u.py::Users.add"), ("inner", "p::u.py::Users.check")]
    assert [(h[1], h[2], h[3]) for h in found.hints] == [("list_users", "/users", "GET"), ("both", "/u", "GET"), ("both", "/u", "POST")]
    assert [(i[0], i[2]) for i in found.imports] == [("import os", []), ("src.store", ["save as keep", "load"])]


def test_script_extraction():
    js = X.extract(FILES["web/app.js"], "JavaScript", "p", "a.js")
    assert [(d[0], d[2]) for d in js.definitions] == [("start", "Function"), ("Box", "Class"), ("open", "Method"), ("get", "Method"), ("listThings", "Function")]
    assert [(h[1], h[2], h[3]) for h in js.hints] == [("listThings", "/things", "GET"), ("open", "/things", "POST")]
    assert [(i[0], i[2]) for i in js.imports] == [("./lib", ["a", "b"]), ("mod", ["d", "f"])]
    assert {c[0] for c in js.calls} >= {"a", "go", "b", "start"} and not {c[0] for c in js.calls} & {"no", "comment", "if"}
    ts = X.extract(FILES["web/api.ts"], "TypeScript", "p", "a.ts")
    assert {(d[0], d[2]) for d in ts.definitions} >= {("Shape", "Interface"), ("Kind", "Enum"), ("Alias", "Class"), ("Ctl", "Class"), ("one", "Method"), ("two", "Method"), ("helper", "Function")}
    assert [(h[1], h[2], h[3]) for h in ts.hints] == [("one", "/n", "GET"), ("two", "/", "POST")]
    assert X.extract("", "Python", "p", "x").definitions == [] and X.extract(None, "Tsx", "p", "x").calls == []


def handlers(n):
    return "".join(f"@app.get('/p/{k}')\ndef f{k}():\n    f{k + 1}()\n" for k in range(n))


def test_a_long_file_takes_time_in_proportion():
    took = []
    for n in (500, 8000):  # where each decorator cut the file into lines anew, the longer took some 250 times as long
        source, start = handlers(n), time.process_time()
        found = X.extract(source, "Python", "p", "a.py")
        took.append(time.process_time() - start)
        assert len(found.hints) == n and found.hints[-1][1:4] == (f"f{n - 1}", f"/p/{n - 1}", "GET")
    assert took[1] < 80 * took[0]


def test_calls_of_expressions_take_time_in_proportion():
    took = []
    for n in (500, 8000):
        source, start = "".join(f"(a or b.c{k})(d)\n" for k in range(n)), time.process_time()
        found = X.extract(source, "Python", "p", "a.py")
        took.append(time.process_time() - start)
        assert len(found.calls) == n and found.calls[-1][:2] == (f"c{n - 1}", n)
    assert took[1] < 80 * took[0]


def test_the_collector_rests_while_a_file_is_read(monkeypatch):
    on = []
    monkeypatch.setattr(X.Found, "call", lambda *_: on.append(gc.isenabled()))
    X.extract("f()", "Python", "p", "a.py")
    X.extract("f()", "JavaScript", "p", "a.js")
    with pytest.raises(SyntaxError):
        X.extract("def x(:", "Python", "p", "b.py")
    assert on == [False, False] and gc.isenabled()


def test_files_of_many_definitions_go_out_alone():
    sources = [handlers(5000), "", None, "def x(:", handlers(9000), "import os", *[""] * (X.ROWS_OUT + 1)]
    texts = [["p"] * len(sources), [f"{k}.py" for k in range(len(sources))], ["Python"] * len(sources), sources]
    out = list(X._rows(iter([pa.RecordBatch.from_arrays([pa.array(t, pa.string()) for t in texts], ["project", "rel_path", "language", "content"])])))
    assert [b.num_rows for b in out] == [4, 1, X.ROWS_OUT - 1, 3]
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["rel_path"] for r in rows] == texts[1] and [k for k, r in enumerate(rows) if r["error"]] == [3]
    assert [len(r["hints"]) for r in rows[:6]] == [5000, 0, 0, 0, 9000, 0]
    assert rows[4]["definitions"][8999] == {"ord": 8999, "name": "f8999", "qualified_name": "p::4.py::f8999", "label": "Function", "line_start": 26999, "line_end": 27000}
    assert rows[5]["imports"] == [{"ord": 0, "module_path": "import os", "alias": None, "names": [], "line": 1}]


@pytest.mark.parametrize("source", ["x = 'é'; import os, sys\r\nfoo('é')(1)\r@a.get('/é')\x0c\ndef f(): pass\n", "import a\\\n, b\nx[\n'é'](1)", "a(\r\n  b\r\n)()()"])
def test_texts_of_nodes_are_those_of_the_standard_library(source):
    reader = X._Python(X.Found("p", "a.py"), source)
    for node in ast.walk(ast.parse(source)):
        if hasattr(node, "lineno"):
            assert reader._text(node) == ast.get_source_segment(source, node)


def test_graph_of_a_repository(bench):
    store = bench.store("shop")
    nodes = {r.qualified_name: r for r in store.nodes().collect()}
    names = {r.id: r.qualified_name for r in nodes.values()}
    edges = {(names[e.source_id], names[e.target_id], e.edge_type): e for e in store.edges().collect()}
    assert nodes["shop"].label == "Project" and nodes["shop::__folder__::src"].label == "Folder" and nodes["shop::src/users.py::__file__"].label == "File"
    assert ("shop", "shop::__folder__::src", "CONTAINS_FOLDER") in edges and ("shop::__folder__::src", "shop::src/store.py::__file__", "CONTAINS_FILE") in edges
    assert ("shop::src/users.py::__file__", "shop::src/users.py::Users.add", "CONTAINS_FILE") in edges
    assert edges["shop::src/users.py::list_users", "shop::src/store.py::load", "CALLS"].confidence == 0.95
    assert edges["shop::src/users.py::Users.add", "shop::src/users.py::Users.check", "CALLS"].confidence == 0.9
    assert ("shop::src/users.py::list_users", "route:GET:/users", "HANDLES") in edges and ("shop::app/users/[id]/route.ts::GET", "route:GET:/users/:id", "HANDLES") in edges
    assert ("shop::tests/test_users.py::__file__", "shop::src/users.py::__file__", "TESTS_FILE") in edges
    assert edges["shop::src/store.py::__file__", "shop::src/users.py::__file__", "CO_CHANGED"].properties == {"co_changes": "3", "coupling_score": "1.00"}
    assert ("shop::tests/test_users.py::test_add", "shop::src/users.py::list_users", "CALLS") in edges


def test_files_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("p", f"src/{k}.py", "Python", handlers(3)) for k in range(5)] + [("p", "tests/test_1.py", "Python", "f0()")]
    files = spark.createDataFrame(rows, "project string, rel_path string, language string, content string")
    nodes, edges, errors = build_graph(files.mapInArrow(counted, files.schema))
    assert {r.label: r["count"] for r in nodes.groupBy("label").count().collect()} == {"Project": 1, "Folder": 2, "File": 6, "Function": 15, "Route": 3}
    got = {r.edge_type: r["count"] for r in edges.groupBy("edge_type").count().collect()}
    assert got == {"CONTAINS_FOLDER": 2, "CONTAINS_FILE": 21, "CALLS": 11, "HANDLES": 15, "TESTS_FILE": 1, "SIMILAR_TO": 30}
    assert errors.count() == 0 and read.value == len(rows)


def test_questions(bench, repo):
    assert {r.name for r in bench.find_dead_code("shop").collect()} >= {"unused", "save"}
    assert "load" not in {r.name for r in bench.find_dead_code("shop").collect()}
    assert ("GET", "/users", "shop::src/users.py::list_users") in {tuple(r) for r in bench.route_handlers("shop").collect()}
    assert {r.label for r in bench.find_routes("shop").collect()} == {"Function", "Method", "Route"}
    fan = bench.trace_fan("shop", "add", root=str(repo), edge_types=("CALLS",)).collect()
    assert {r.name for r in fan} == {"add", "check", "load", "inner"} and "self.check(x)" in next(r.body for r in fan if r.name == "add")
    assert bench.trace_path("shop", "shop::tests/test_users.py::test_add", "shop::src/store.py::load").count() == 3
    told = bench.get_architecture("shop").first()
    assert told.languages == ["JavaScript", "Python", "TypeScript"] and "src" in told.packages and told.entry_points == []
    assert {r.rel_path for r in bench.search_code(str(repo), "def load").collect()} == {"src/store.py"}
    assert bench.get_snippet("shop", "shop::src/store.py::save", str(repo), 0).first().source == "def save(): load()"
    assert bench.get_graph_schema("shop").first().node_count == bench.index_status("shop")["node_count"]
    assert {r.name for r in bench.callers("shop", "shop::src/store.py::load").collect()} == {"list_users", "add", "save"}
    assert [p["name"] for p in bench.list_projects()] == ["shop"]


def test_incremental_and_stream(spark, bench, repo, tmp_path):
    assert bench.detect_changes(str(repo)).isEmpty() and not bench.index_repository(str(repo))["changed"]
    before = bench.index_status("shop")["node_count"]
    (repo / "src/extra.py").write_text("def brand_new(): load()\n")
    (repo / "src/broken.py").unlink()
    assert {tuple(r) for r in bench.detect_changes(str(repo)).collect()} == {("src/extra.py", "added"), ("src/broken.py", "deleted")}
    query = W.watch(spark, str(repo / "src"), bench.store("src"), f"file://{tmp_path}/cp", once=True)
    query.awaitTermination(120)
    assert query.exception() is None and bench.store("src").status()["indexed"]
    assert bench.index_repository(str(repo))["changed"] and bench.index_status("shop")["node_count"] > before
    assert bench.delete_project("src") and not bench.delete_project("src") and not bench.index_status("src")["indexed"]
    with pytest.raises(FileNotFoundError):
        bench.store("src").nodes()


def test_commits(spark, tmp_path):
    assert S.git_log(spark, str(tmp_path)).count() == 0
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init")
    for k in range(2):
        (tmp_path / "x.py").write_text(str(k))
        (tmp_path / f"y{k}.py").write_text("")
        run("add", ".")
        run("commit", "-m", "m")
    assert sorted((r.commit_ord, r.path) for r in S.git_log(spark, str(tmp_path)).collect()) == [(1, "x.py"), (1, "y1.py"), (2, "x.py"), (2, "y0.py")]


def test_usage_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01 00:00:10", "t", 3, 9), ("2025-01-01 00:00:50", "t", 1, 1), ("2025-01-01 00:01:10", "u", 2, 2)], "ts string, tool string, content_tokens long, baseline_tokens long")
    rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema("ts timestamp, tool string, content_tokens long, baseline_tokens long").parquet(f"{tmp_path}/calls")
    query = W.usage_stream(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.tool, r.queries, r.content_tokens) for r in spark.table("usage").collect()) == [("t", 2, 4), ("u", 1, 2)]


def test_many_ignore_rules(spark):
    rules = [r for k in range(600) if (r := S.ignore_regex(f"{'!' * (k % 3 == 2)}f{k // 3}.*" if k % 3 else f"dir{k}/"))]
    paths = spark.createDataFrame([("dir3/a.py",), ("f1.py",), ("f7.x",), ("other.py",)], "p string")
    assert [r[0] for r in paths.coalesce(1).filter(~S.ignored(F.col("p"), rules)).collect()] == ["f1.py", "f7.x", "other.py"]
