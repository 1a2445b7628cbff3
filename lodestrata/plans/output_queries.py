"""Every command-output parser over texts rendered from the events of a user, cell by cell against SQL.

A parser's text and the rows that it should give are templates, whose fields are SQL that Spark and the oracle both
read: of each event (I its id, T its type, pos its place, n and e how many events and errors there are) or, once in a
text, of n and e.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import html, markdown
from lodestrata.functions.output import engine
from lodestrata.plans.star_graph import table

QUERIES, SQL, CASES = {}, {}, []
ERROR = "event_type = 'error'"
RULE, DASHES = "=" * 70, "-" * 70
_NAMES = {"I": "event_id", "T": "event_type"}


def _sql(template: str) -> str:
    """A template as a concatenation."""
    parts = []
    for said, field, _, _ in Formatter().parse(template):
        for ch, code in (("\n", 10), ("\t", 9), ("'", 39)):
            said = said.replace(ch, f"\0{code}\0")
        parts += [f"chr({x})" if k % 2 else f"'{x}'" for k, x in enumerate(said.split("\0")) if x]
        if field:
            parts.append(f"CAST({_NAMES.get(field, field)} AS STRING)")
    return " || ".join(parts or ["''"])


def _many(n: str, word: str, ending: str = "s") -> str:
    return f"{{{n}}}{{CASE WHEN {n} = 1 THEN ' {word}' ELSE ' {word}{ending}' END}}"


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr(ERROR), 1)).alias("e")]


@dataclass
class Case:
    """hint and tool; line for each event where where holds, between head and tail; the row that each row_where gives,
    after first; summary."""

    hint: str
    tool: str
    line: str
    row: str
    summary: str
    head: str = ""
    tail: str = ""
    where: str = "true"
    row_where: str = "true"
    first: str = ""
    verbose: bool = False

    def lines(self) -> Column:
        """Aggregates the lines of a user's events, in order."""
        rows = F.array_sort(F.collect_list(F.struct("event_id", F.expr(f"CASE WHEN {self.where} THEN {_sql(self.line)} END").alias("line"))))
        return F.array_join(F.transform(rows, lambda x: x["line"]), "\n")

    def text(self, lines: Column) -> Column:
        return F.concat(F.expr(_sql(self.head)), lines, F.expr(_sql(self.tail)))

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = table(spark, sf_dir, "events").groupBy("user_id").agg(self.lines().alias("lines"), *_counts())
        found = texts.select("user_id", engine.parse_output_column(self.text(F.col("lines")), self.hint, self.verbose).alias("p"))
        cells = F.array_join(F.transform("p.rows", lambda r: F.array_join(r, "|")), "\n")
        return found.select("user_id", "p.tool", "p.summary", cells.alias("cells"))

    def oracle(self) -> str:
        first = f"{_sql(self.first)} || chr(10) || " if self.first else ""
        return f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n, count(*) FILTER ({ERROR}) OVER (PARTITION BY user_id) AS e FROM events),
g AS (SELECT user_id, any_value(n) AS n, any_value(e) AS e, coalesce(string_agg({_sql(self.row)}, chr(10) ORDER BY event_id) FILTER ({self.row_where}), '') AS cells FROM x GROUP BY user_id)
SELECT user_id, '{self.tool}' AS tool, {_sql(self.summary)} AS summary, {first}cells AS cells FROM g"""


_STATE = "{CASE WHEN event_type = 'error' THEN '%s' ELSE '%s' END}"
_HASH = "{lpad(CAST(event_id AS STRING), 8, '0')}"
_DIFF = "diff --git a/f{I}.py b/f{I}.py\nindex 1..2\n--- a/f{I}.py\n+++ b/f{I}.py\n@@ -1 +1 @@\n-a\n+{T}"
_DIFF_ROW, _DIFF_SUM = "f{I}.py|2|@@ -1 +1 @@\n-a\n+{T}", _many("n", "file") + ", {n * 2} changes"

for _case in (
    Case("pytest", "pytest", "FAILED t/f.py::test_{I} - assert {I}", "test_{I}|FAILED|t/f.py||assert {I}", "{e} failed, {n - e} passed in 0.1s", "===== test session starts =====\n=== short test summary info ===\n", "\n===== {e} failed, {n - e} passed in 0.1s =====", ERROR, ERROR),
    Case("unittest", "unittest", f"{RULE}\nFAIL: test_{{I}} (m.T)\n{DASHES}\n  File \"m.py\", line {{I}}, in test\nAssertionError: {{T}}", "test_{I}|FAIL|m.py|{I}|AssertionError: {T}", "{CASE WHEN n > e AND e > 0 THEN (n - e) || ' passed, ' || e || ' failed' WHEN e > 0 THEN e || ' failed' ELSE n || ' passed' END}", tail=f"\n{DASHES}\nRan {{n}} tests in 0.1s\n\nFAILED (failures={{e}})", where=ERROR, row_where=ERROR),
    Case("ruff", "ruff", "src/f{event_id % 3}.py:{I}:1: E{event_id % 900 + 100} {T} it", "src/f{event_id % 3}.py|{I}|1|E{event_id % 900 + 100}|error|{T} it", _many("n", "violation"), verbose=True),
    Case("mypy", "mypy", "m.py:{I}: error: wrong {T}  [{T}]", "m.py|{I}||error|{T}|wrong {T}", _many("n", "error"), verbose=True),
    Case("pyright", "pyright", "  /x/a.py:{I}:2 - warning: odd {T} (reportX)", "/x/a.py|{I}|2|warning|reportX|odd {T}", _many("n", "warning"), "/x/a.py\n", "\n0 errors, {n} warnings, 0 informations", verbose=True),
    Case("pip", "pip", "{T}{I} 1.0 requires b>={I}, but you have b 0.1 which is incompatible.", "{T}{I}|conflict|requires b>={I}, have b 0.1", _many("n", "issue")),
    Case("traceback", "python-traceback", "Traceback (most recent call last):\n  File \"a.py\", line {I}, in f\n    g()\nValueError: {T}\n\nDuring handling of the above exception, another exception occurred:\n", "ValueError|a.py|{I}|f|{T}", "{CASE WHEN n = 1 THEN 'ValueError' ELSE n || ' exceptions' END}"),
    Case("jest", "jest", "  ● A › t{I}\n\n    expect {T}\n      at Object.x (t/a.test.ts:{I}:7)\n", "A › t{I}|FAILED|t/a.test.ts|{I}|expect {T}", "0 passed, {n} failed", tail="\nTest Suites: 1 failed\nTests: {n} failed, 0 passed, {n} total"),
    Case("vitest", "vitest", "FAIL src/a.test.ts > t{I}\nAssertionError: {T}\n ❯ src/a.test.ts:{I}:2\n", "t{I}|FAILED|src/a.test.ts|{I}|AssertionError: {T}", "0 passed, {n} failed", tail="\n Test Files  1 failed\n Tests  {n} failed | 0 passed\n Duration 1s"),
    Case("mocha", "mocha", "  {I}) case {T}:\n     Error: no\n      at Context.x (t/a.js:{I}:2)", "case {T}|FAILED|t/a.js|{I}|Error: no", "0 passed, {n} failed", "  0 passing (1s)\n  {n} failing\n\n"),
    Case("tsc", "tsc", "a.ts({I},1): error TS{event_id % 900 + 1000}: {T}", "a.ts|{I}|1|error|TS{event_id % 900 + 1000}|{T}", _many("n", "error"), verbose=True),
    Case("eslint", "eslint", "  {I}:2  error  {T} is unused  no-unused", "/x/a.js|{I}|2|no-unused|error|{T} is unused", _many("n", "violation"), "/x/a.js\n", "\n\n✖ {n} problems", verbose=True),
    Case("webpack", "webpack", "ERROR in ./{T}{I}.ts\nm1\nm2\nm3\nm4\n", "./{T}{I}.ts|error|m1 m2 m3", _many("n", "error"), tail="\nwebpack compiled with errors"),
    Case("vite", "vite", "src/{T}.ts({I},1): error TS2322: bad", "src/{T}.ts:{I}|error|TS2322: bad", _many("n", "error")),
    Case("npm", "npm", "npm warn deprecated {T}@{I}: old one", "{T}@{I}|deprecated|old one", _many("n", "issue")),
    Case("cargo-test", "cargo-test", "---- t::f{I} stdout ----\nthread 't' panicked at src/l.rs:{I}:5:\nassertion {T}\n", "t::f{I}|FAILED|src/l.rs|{I}|assertion {T}", "{n - e} passed, {e} failed", "running {n} tests\n", "\ntest result: FAILED. {n - e} passed; {e} failed; 0 ignored", ERROR, ERROR),
    Case("cargo-build", "cargo-build", "error[E0308]: bad {T}\n  --> src/m.rs:{I}:5", "src/m.rs|{I}|5|error|E0308|bad {T}", _many("n", "error") + ", 0 warnings"),
    Case("clippy", "cargo-clippy", "warning: odd {T}\n  --> src/m.rs:{I}:2\n  = note: clippy::some_rule\n", "src/m.rs|{I}|2|clippy::some_rule|warning|odd {T}", _many("n", "warning"), tail="\nwarning: x generated 9 warnings", verbose=True),
    Case("docker", "docker", " => ERROR [1/2] RUN {T} {I}", "[1/2]|ERROR|RUN {T} {I}", _many("n", "error")),
    Case("git-diff", "git-diff", _DIFF, _DIFF_ROW, _DIFF_SUM),
    Case("git-status", "git-status", "\tmodified:   f{I}.py", "f{I}.py|modified|false", "Files: {n} (M:{n})", "On branch main\nChanges not staged for commit:\n"),
    Case("git-log", "git-log", f"{_HASH} {{T}} {{I}}", f"{_HASH}|{{T}} {{I}}", "{CASE WHEN n = 1 THEN '1 entry' WHEN n <= 10 THEN n || ' entries' ELSE '10 entries (showing 10 of ' || n || ')' END}", row_where="pos <= 10"),
    Case("git-show", "git-show", _DIFF, _DIFF_ROW, "abababab: Msg — " + _DIFF_SUM, f"commit {'ab' * 20}\nAuthor: A\nDate: d\n\n    Msg\n\n"),
    Case("git-blame", "git-blame", f"{_HASH} (Al Bo  2025-03-01 10:00:00 +0000  {{I}}) x", f"{{I}}|{_HASH}|Al Bo", "{n} lines, 1 author, " + _many("n", "range")),
    Case("git-branch", "git-branch", "  b{I}", "b{I}|false|", "{n + 1} branches, current: main", "* main\n", first="main|true|"),
    Case("git-stash", "git-stash", "stash@{{{I}}}: On main: {T}", "{CASE WHEN n > 10 AND pos = 6 THEN '... (' || (n - 7) || ' more)||' ELSE event_id || '|main|' || event_type END}", _many("n", "stash", "es"), row_where="n <= 10 OR pos <= 6 OR pos > n - 2"),
    Case("kubectl", "kubectl", "{rpad('p' || event_id, 20, ' ')}1/1    {rpad(CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Running' END, 12, ' ')}5d", "p{I}|1/1|Error|5d", "{n} pods ({n - e} healthy{CASE WHEN e > 0 THEN ', ' || e || ' unhealthy' ELSE '' END})", "NAME                READY  STATUS      AGE\n", row_where=ERROR),
    Case("docker-compose", "docker-compose", "{rpad('c' || event_id, 16, ' ')}i       c         {rpad('s' || event_id, 16, ' ')}{rpad(CASE WHEN event_type = 'error' THEN 'Exited (1)' ELSE 'Up 1 hour' END, 14, ' ')}80", "s{I}|Exited (1)|80", "{CASE WHEN e = 0 THEN n || ' services, all healthy' ELSE n || ' services (' || (n - e) || ' healthy, ' || e || ' unhealthy)' END}", "NAME            IMAGE   COMMAND   SERVICE         STATUS        PORTS\n", row_where=ERROR),
    Case("docker-ps", "docker-ps", "{rpad(CAST(event_id AS STRING), 15, ' ')}img     " + _STATE % ("Exited (1)   ", "Up 2 hours   ") + "80      n{I}", "n{I}|img|Up 2 hours|80", "{n} containers ({n - e} running{CASE WHEN e > 0 THEN ', ' || e || ' stopped' ELSE '' END})", "CONTAINER ID   IMAGE   STATUS       PORTS   NAMES\n", row_where=f"NOT {ERROR}"),
    Case("docker-logs", "docker-logs", "2025-01-01T00:00:00Z " + _STATE % ("ERROR", "INFO") + " {T} {I}", "2025-01-01T00:00:00Z " + _STATE % ("ERROR", "INFO") + " {T} {I}", "{n} log lines, " + _many("e", "error"), verbose=True),
    Case("pip-freeze", "package-list", "{T}{I}=={event_id % 7}.0", "{T}{I}|{event_id % 7}.0", "{n} packages", verbose=True),
    Case("ls", "file-listing", "-rw-r--r-- 1 u g {I} Jan 1 10:00 {T}{I}", "{T}{I}|file|{I}", "{n} entries", verbose=True),
    Case("grep", "search-results", "a.py:{I}:{T}", "a.py|{I}|{T}", "{n} matches across 1 files", verbose=True),
    Case("gh", "gh-cli", "#{I}\t{T}\tfeat/a\tOPEN", "{I}|{T}|feat/a|OPEN", "{n} pull requests", verbose=True),
    Case("env", "env-redact", "V{I}" + _STATE % ("_KEY", "") + "={T}", "V{I}{CASE WHEN event_type = 'error' THEN '_KEY|[REDACTED]' ELSE '|' || event_type END}", "{n} vars ({e} redacted)"),
):
    _name = f"cells_{_case.hint.replace('-', '_')}"
    QUERIES[_name], SQL[_name] = _case.spark, _case.oracle()
    CASES.append(_case)


#: Tools whose outputs, as rendered above, say too little for their own parser to win without a hint: what wins instead.
#: Diagnostics that lack their closing line look like hits of a search, for instance.
ALIKE = {
    "cargo-build": "search-results", "docker": None, "docker-logs": "kubectl", "file-listing": "search-results", "git-log": None, "mypy": "search-results",
    "package-list": "env-redact", "pip": None, "ruff": "search-results", "vite": "tsc",
}
PROSE = Case("", "prose", "it was a {T} that came along", "", "")


def detect_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool found, without a hint, for an output of each tool, and for prose, by all events of a user (over 30 of
    them: scores of log lines grow with their number)."""
    said = [*CASES, PROSE]
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(*[c.lines().alias(f"lines_{k}") for k, c in enumerate(said)], *_counts())
    texts = F.array(*[F.struct(F.lit(c.tool).alias("rendered"), c.text(F.col(f"lines_{k}")).alias("text")) for k, c in enumerate(said)])
    return events.select("user_id", F.inline(texts)).select("user_id", "rendered", engine.detect_column(F.col("text")).alias("tool"))


_FOUND = {c.tool: ALIKE.get(c.tool, c.tool) for c in CASES} | {PROSE.tool: None}
QUERIES["detect_tools"] = detect_tools
SQL["detect_tools"] = "SELECT user_id, rendered, tool FROM (SELECT DISTINCT user_id FROM events), (VALUES " + ", ".join(f"('{tool}', {repr(found) if found else 'NULL'})" for tool, found in _FOUND.items()) + ") AS found(rendered, tool)"


def rendered(spark: SparkSession, sf_dir: str, line: str, head: str = "", tail: str = "") -> DataFrame:
    """A text for each user: head, a line for each event in order, tail."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.expr(_sql(line)).alias("line")))), lambda x: x["line"])
    texts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(rows, "\n").alias("lines"))
    return texts.select("user_id", F.concat(F.expr(_sql(head)), F.col("lines"), F.expr(_sql(tail))).alias("text"))


PAGE = '<h2 class="x">{T}</h2><p>{I} is <b>bold</b> and <a href="/u/{I}" id=k>here</a></p><ul><li>one {I}<li>two</ul><div class="cookie-bar">no</div>'
PAGE_HEAD, PAGE_TAIL = "<html><head><title>t</title></head><body><nav>n</nav><!-- c --><script>x()</script>", "</body></html>"


def _page_query(mode: str, each: str, between: str = "\n", head: str = "", tail: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rendered(spark, sf_dir, PAGE, PAGE_HEAD, PAGE_TAIL).select("user_id", html.clean_html_column(F.col("text"), mode).alias("text"))

    QUERIES[f"page_{mode}"] = run
    SQL[f"page_{mode}"] = f"SELECT user_id, {_sql(head)} || string_agg({_sql(each)}, {_sql(between)} ORDER BY event_id) || {_sql(tail)} AS text FROM events GROUP BY user_id"


_page_query("markdown", "## {T}\n{I} is\n**bold**\nand\n[here](/u/{I})\n- one {I}\n- two")
_page_query("text", "{T}\n{I} is\nbold\nand\nhere\none {I}\ntwo", "\n\n")
_page_query("minimal", '<h2 class="x">{T}</h2><p>{I} is <b>bold</b> and <a href="/u/{I}" id="k">here</a></p><ul><li>one {I}</li><li>two</li></ul><div class="cookie-bar">no</div>', head="<body><nav>n</nav>", tail="</body>")


def generic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output of an unknown command whose lines repeat; short ones stay as they are."""
    return rendered(spark, sf_dir, "it was a {T} that came along").select("user_id", engine.compact_output_column(F.col("text")).alias("text"))


def outline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section and one below it for each event. A section below a better one is no hit of its own."""
    docs = rendered(spark, sf_dir, "# alpha beta {T} {I}\nwhat happened\n## alpha beta notes {I}\nan {T}\n")
    hits = markdown.hits_of(docs.withColumn("query", F.lit("alpha beta error")), "text", "query", ("user_id",))
    return hits.select("user_id", F.col("rank").cast("long").alias("rank"), "title", "path", "score", "match_type", "content")


QUERIES |= {"generic_runs": generic_runs, "outline_search": outline_search}
SQL["generic_runs"] = f"""WITH e AS (SELECT *, {_sql("it was a {T} that came along")} AS line, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events),
r AS (SELECT *, sum((event_type IS DISTINCT FROM prev)::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e), g AS (SELECT user_id, run, min(line) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS line FROM r GROUP BY ALL),
a AS (SELECT user_id, string_agg(line, chr(10) ORDER BY event_id) AS plain FROM e GROUP BY user_id), b AS (SELECT user_id, string_agg(line, chr(10) ORDER BY run) AS short FROM g GROUP BY user_id)
SELECT user_id, CASE WHEN length(plain) < 500 THEN plain ELSE short END AS text FROM a JOIN b USING (user_id)"""
SQL["outline_search"] = f"""WITH x AS (SELECT *, bool_or({ERROR}) OVER (PARTITION BY user_id) AS any_error FROM events),
h AS (SELECT user_id, event_id, {_sql("alpha beta {T} {I}")} AS title, {_sql("# alpha beta {T} {I}")} AS path, 1.05 AS score, 'header' AS match_type, {_sql("what happened" + chr(10) * 2 + "## alpha beta notes {I}" + chr(10) * 2 + "an {T}")} AS content FROM x WHERE any_error AND {ERROR}
 UNION ALL SELECT user_id, event_id, {_sql("alpha beta notes {I}")}, {_sql("# alpha beta {T} {I} > ## alpha beta notes {I}")}, 0.767, 'content', {_sql("an {T}")} FROM x WHERE NOT any_error
 UNION ALL SELECT user_id, event_id + 1000000000, {_sql("alpha beta {T} {I}")}, {_sql("# alpha beta {T} {I}")}, 0.717, 'content', {_sql("what happened" + chr(10) * 2 + "## alpha beta notes {I}" + chr(10) * 2 + "an {T}")} FROM x WHERE NOT any_error),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM h)
SELECT user_id, rank, title, path, score::DOUBLE AS score, match_type, content FROM r WHERE rank <= 5"""
