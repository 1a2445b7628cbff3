import json

import pytest

from lodestrata.functions import commands as C
from lodestrata.functions import compact_json as J
from lodestrata.functions import html as H
from lodestrata.functions import markdown as M


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ([], "[]"), ([1, None, True, "a;b"], '[1;;true;"a;b"]'), ({"a": 1, "b": None}, "[a;b]\n1;"), ({"a": {"b": 1, "c": [1, 2]}}, "[a:{b;c}]\n{1;[1;2]}"),
        ([{"name": "x", "age": 3, "ok": False}, {"name": "y", "city": "p"}], "[name;age;ok;city]\nx;3;false;\ny;;;p"),
        ([{"t": [{"a": 1}]}, {"t": [{"b": 2}]}], "[t:[{a;b}]]\n[{1}]\n[{2}]"), ([{"t": None}, {"t": [{"b": 2}]}], "[t:[{b}]]\n\n[{2}]"),
        ({"s": 'say "hi"'}, '[s]\nsay "hi"'), ({"s": 'say "hi";'}, '[s]\n"say ""hi"";"'), ({"e": []}, "[e]\n[]"), ({"f": 1.0}, "[f]\n1.0"), ("x", "x"), (True, "True"), (None, "None"),
    ],
)
def test_compact_json(value, want):
    assert J.compact_json(json.dumps(value)) == want


def test_json_edges():
    assert J.compact_json(" \n") == "" and J.compact_if_shorter(None) == ""
    with pytest.raises(ValueError):
        J.compact_json("{")
    assert J.compact_if_shorter("{") == "{" and J.compact_if_shorter("[]") == "[]"
    long = json.dumps([{"identifier": k, "description": "d"} for k in range(5)])
    assert len(J.compact_if_shorter(long)) < len(long)
    assert J.compact_json('[{"t":[{"a":1}]},{"t":[{"b":2}]}]', aligned=True).split("\n")[1:] == ["[{1;}]", "[{;2}]"]


DOC = "intro\n# Setup\ninstall it\n## Auth tokens\nuse a token\n```\n# not a header\n```\n### Deep\nauth here\n# Other\n    # code\nnothing"


def test_markdown_sections():
    got = [(s.level, s.title, s.parent_id) for s in M.parse_markdown(DOC)]
    assert got == [(0, "", None), (1, "Setup", None), (2, "Auth tokens", 1), (3, "Deep", 2), (1, "Other", None)]
    assert M.parse_markdown(" \n") == [] and M.parse_markdown(None) == []
    assert M.parse_markdown("~~~\n# x\n~~~\n#no\n####### seven\n# yes")[1].title == "yes"


def test_markdown_search():
    hits = M.search_sections(DOC, "auth")
    assert [(h["title"], h["score"], h["match_type"]) for h in hits] == [("Auth tokens", 1.1, "header")]
    assert hits[0]["path"] == "# Setup > ## Auth tokens" and "### Deep" in hits[0]["content"]
    assert M.search_markdown(DOC, "").startswith("Document headers:\n(preamble) (~1 tokens)\n# Setup")
    assert M.search_markdown(DOC, "zebra").startswith('No matches for "zebra". Document headers:')
    assert M.search_markdown("", "x") == ""
    assert M.search_markdown(DOC, "auth").startswith("Matches: 1 | Document: ~")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<h2>T</h2><p>a <b>bold</b> <i>it</i></p>", "## T\na\n**bold**\n*it*"), ("<nav>x</nav><div class='sidebar-x'>y</div><div class=ad>z</div>", "z"),
        ('<a href="/u" class=k>t</a><a href="/v"></a><img src="s" alt="">', "[t](/u)"), ("<ul><li>a<li><li>b</ul><ol><li>x<li>y</ol>", "- a\n- b\n1. x\n2. y"),
        ("<table><tr><td>1<td>2<tr><th>h</table>", "| 1 | 2 |\n| h |\n| --- |"), ("<pre>a\n  b</pre><blockquote>q <b>r</b></blockquote>", "```\na\n b\n```\n> q **r**"),
        ("<script>x</script><style>y</style><!-- c -->t&amp;u", "t&u"), ("<p>Head¶</p>", "Head"), ("", ""), (None, ""),
    ],
)
def test_clean_html(page, want):
    assert H.clean_html(page) == want


def test_html_modes():
    page = "<html><head><title>t</title></head><body><nav>n</nav><p id=a>x</p><p>y</p></body></html>"
    assert H.clean_html(page, "text") == "x\ny"
    assert H.clean_html(page, "minimal") == '<body><nav>n</nav><p id="a">x</p><p>y</p></body>'
    with pytest.raises(ValueError):
        H.clean_html(page, "loud")


@pytest.mark.parametrize(
    ("command", "hint"),
    [
        ("git diff --stat", "git-diff"), ("git difftool", None), ("pytest", "pytest"), ("python3 -m pytest x", "pytest"), ("ls | wc", None), ("ls > f", None), ("vim a", None),
        ("cat a.py", None), ("cat 'a.py'", None), ("rg x", "rg"), ("find . -name x", "find"), ("docker compose ps", "docker-compose"), ("cargo check", "cargo-build"), ("", None), (None, None), ("echo", None),
    ],
)
def test_match_command(spark, command, hint):
    assert C.match_command(command) == hint


def test_command_column_equals_function(spark):
    said = ["git diff", "  git log -3 ", "cat x.rs", "cat x.txt", "head -1 'a.go'", "npm run x", "ag y", "less z", "tree", "env", "a|b", "", None, "kubectl\tget", "grep -rn x"]
    rows = spark.createDataFrame([(s,) for s in said], "c string").coalesce(1)
    assert [r[0] for r in rows.select(C.command_hint(rows["c"])).collect()] == [C.match_command(s) for s in said]


def test_chains():
    assert C.split_chain("cd x && git diff 'a;b' ; ls") == ["cd x", "git diff 'a;b'", "ls"]
    assert C.split_chain('echo "a && b" & c') == ['echo "a && b" & c']
    assert C.find_primary(["git diff", "cd x"]) == "git diff" and C.find_primary(["cd x", "mkdir y"]) == "mkdir y" and C.find_primary([]) == ""
    assert C.wrapped_command("cd x && pytest", "run") == "run 'cd x && pytest'" and C.wrapped_command("cd x", "run") == "cd x"


@pytest.mark.parametrize("tag", ["div", "blockquote", "span", "ul><li", "p"])
def test_deep_pages(tag):
    page = f"<{tag}>" * 20_000 + "x"
    assert H.clean_html(page, "text") == "x" and H.clean_html(page, "minimal").count(tag[:2]) >= 20_000
    assert H.clean_html(page).endswith("x")


def test_deep_json(spark):
    deep = "[" * 30_000 + "]" * 30_000
    with pytest.raises(ValueError):
        J.compact_json(deep)
    assert J.compact_if_shorter(deep) == deep
    rows = spark.createDataFrame([(deep,), ("[1]",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in rows.select(J.compact_json_column(rows["t"])).collect()] == [None, "[1]", None]


def test_functions_in_sql(spark):
    from lodestrata.api import register_functions

    register_functions(spark)
    row = spark.sql("SELECT match_command('git diff x') AS a, clean_html('<h1>T</h1>') AS b, compact_output('two  words') AS c, compact_json('{\"a\":1}') AS d, match_command(NULL) AS e").first()
    assert tuple(row) == ("git-diff", "# T", "two  words", "[a]\n1", None)
