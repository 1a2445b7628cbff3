import pytest

from lodestrata.functions.output import engine as E
from lodestrata.functions.output.generic import generic_clean
from lodestrata.functions.output.reading import Text

SAMPLES = {
    "pytest": (
        "===== test session starts =====\nt/a.py::test_x PASSED [ 50%]\nt/a.py::test_y FAILED [100%]\n____ test_y ____\nt/a.py:9: AssertionError\n=== short test summary info ===\nFAILED t/a.py::test_y - assert 1 == 2\n===== 1 failed, 1 passed in 0.1s =====",
        "1 failed, 1 passed in 0.1s", [["test_y", "FAILED", "t/a.py", "9", "assert 1 == 2"]],
    ),
    "unittest": (
        "F.\n======\nFAIL: test_a (m.T)\n------\nTraceback\n  File \"m.py\", line 3, in test_a\nAssertionError: no\n\n------\nRan 2 tests in 0.001s\n\nFAILED (failures=1)".replace("======", "=" * 70).replace("------", "-" * 70),
        "1 passed, 1 failed", [["test_a", "FAIL", "m.py", "3", "AssertionError: no"]],
    ),
    "ruff": ("a.py:1:2: F401 unused\nFound 1 error.", "1 issue across 1 rule", [["a.py", "1", "2", "F401", "convention", "unused"]]),
    "mypy": ("a.py:1: error: bad  [arg-type]\na.py:2: note: hint\nFound 1 error in 1 file", "1 issue across 1 rule", [["a.py", "1", "", "error", "arg-type", "bad"]]),
    "pyright": ("a.py\n  /x/a.py:1:2 - error: bad (reportX)\n1 error, 0 warnings, 0 informations", "1 issue across 1 rule", [["/x/a.py", "1", "2", "error", "reportX", "bad"]]),
    "pip": ("ERROR: pip's dependency resolver does not\nfoo 1.0 requires bar>=2, but you have bar 1.0 which is incompatible.", "2 issues", [["pip", "error", "pip's dependency resolver does not"], ["foo", "conflict", "requires bar>=2, have bar 1.0"]]),
    "python-traceback": ('Traceback (most recent call last):\n  File "a.py", line 1, in f\n    g()\nKeyError: 1\n\nDuring handling of the above exception, another exception occurred:\n\nTraceback (most recent call last):\n  File "b.py", line 2, in h\nValueError: no', "2 exceptions", [["KeyError", "a.py", "1", "f", "1"], ["ValueError", "b.py", "2", "h", "no"]]),
    "jest": ("  ● A › b\n\n    expect failed\n      at Object.<anonymous> (t/a.test.ts:5:7)\n\nTest Suites: 1 failed\nTests: 1 failed, 2 passed, 3 total", "2 passed, 1 failed", [["A › b", "FAILED", "t/a.test.ts", "5", "expect failed"]]),
    "vitest": ("FAIL src/a.test.ts > x > y\nAssertionError: no\n ❯ src/a.test.ts:4:2\n\n Test Files  1 failed\n Tests  1 failed | 2 passed (3)\n Duration 1s", "2 passed, 1 failed", [["x > y", "FAILED", "src/a.test.ts", "4", "AssertionError: no"]]),
    "mocha": ("  2 passing (1s)\n  1 failing\n\n  1) S t:\n     Error: no\n      at Context.<anonymous> (t/a.js:4:2)\n      at x (node_modules/m.js:1:1)", "2 passed, 1 failed", [["S t", "FAILED", "t/a.js", "4", "Error: no"]]),
    "tsc": ("src/a.ts(4,5): error TS2322: bad type", "1 issue across 1 rule", [["src/a.ts", "4", "5", "error", "TS2322", "bad type"]]),
    "eslint": ("/x/a.js\n  1:2  error  'x' unused  no-unused-vars\n\n✖ 1 problem (1 error, 0 warnings)", "1 issue across 1 rule", [["/x/a.js", "1", "2", "no-unused-vars", "error", "'x' unused"]]),
    "webpack": ("ERROR in ./a.ts\nm1\nm2\nm3\nm4\n\nwebpack compiled with 1 error", "1 error", [["./a.ts", "error", "m1 m2 m3"]]),
    "vite": ("vite v5\nerror during build:\nsomething broke", "1 error", [["build", "error", "something broke"]]),
    "npm": ("npm warn deprecated a@1: old one\nnpm error code E1\nnpm error path /x/node_modules/left/y", "3 issues", [["a@1", "deprecated", "old one"], ["npm", "error", "code E1"], ["left", "error", "path /x/node_modules/left/y"]]),
    "cargo-test": ("running 2 tests\ntest t::a ... ok\ntest t::b ... FAILED\n\n---- t::b stdout ----\nthread 't::b' panicked at src/l.rs:4:5:\nassertion failed\n\ntest result: FAILED. 1 passed; 1 failed; 0 ignored", "1 passed, 1 failed", [["t::b", "FAILED", "src/l.rs", "4", "assertion failed"]]),
    "cargo-build": ("   Compiling x v0.1\nerror[E0308]: mismatched\n  --> src/m.rs:4:5\n", "1 error, 0 warnings", [["src/m.rs", "4", "5", "error", "E0308", "mismatched"]]),
    "cargo-clippy": ("warning: needless return\n  --> src/m.rs:1:2\n  = note: `#[warn(clippy::needless_return)]`\n\nwarning: `x` (bin) generated 1 warning", "1 issue across 1 rule", [["src/m.rs", "1", "2", "clippy::needless_return", "warning", "needless return"]]),
    "docker": ("[+] Building 1s\n => [1/2] FROM x\n => ERROR [2/2] RUN y\nERROR: failed to solve", "2 errors", [["[2/2]", "ERROR", "RUN y"], ["", "ERROR", "failed to solve"]]),
    "git-diff": ("diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1,9 +1,9 @@\n c1\n c2\n c3\n c4\n-a\n+b\n d1\n d2\n d3\n d4\ndiff --git a/yarn.lock b/yarn.lock\n+++ b/yarn.lock\n+p\n+q", "2 files, 4 changes", [["x.py", "2", "@@ -1,9 +1,9 @@\n c2\n c3\n c4\n-a\n+b\n d1\n d2\n d3"], ["yarn.lock", "2", "(lockfile changed, 2 lines)"]]),
    "git-status": ("On branch main\nChanges to be committed:\n\tnew file:   a.py\n\nChanges not staged for commit:\n\tmodified:   b.py\n\nUntracked files:\n\tc.py\n", "Files: 3 (M:1, ?:1, O:1)", [["a.py", "new file", "true"], ["b.py", "modified", "false"], ["c.py", "untracked", "false"]]),
    "git-log": ("commit " + "ab" * 20 + "\nAuthor: A\nDate:   d\n\n    First line\n\n    body\n", "1 entry", [["abababab", "First line"]]),
    "git-show": ("commit " + "ab" * 20 + "\nAuthor: A\nDate: d\n\n    Msg\n\ndiff --git a/f b/f\n@@ -1 +1 @@\n-a\n+b", "abababab: Msg — 1 file, 2 changes", [["f", "2", "@@ -1 +1 @@\n-a\n+b"]]),
    "git-blame": ("\n".join(f"^a1b2c3d (Al Bo  2025-03-01 10:00:00 +0000  {k}) x" for k in (1, 2)) + "\n11111111 (Cy  2025-03-01 10:00:00 +0000  3) y", "3 lines, 2 authors, 2 ranges", [["1-2", "a1b2c3d", "Al Bo"], ["3", "11111111", "Cy"]]),
    "git-branch": ("* main\n  feat/a\n", "2 branches, current: main", [["main", "true", ""], ["feat/a", "false", ""]]),
    "git-stash": ("stash@{0}: WIP on main: a1 msg\nstash@{1}: On dev: other", "2 stashes", [["0", "main", "a1 msg"], ["1", "dev", "other"]]),
    "kubectl": ("NAME   READY   STATUS    AGE\na      1/1     Running   1d\nb      0/1     Running   1d\nc      0/1     Completed 1d", "3 pods (1 healthy, 1 completed, 1 unhealthy)", [["b", "0/1", "Running", "1d"]]),
    "docker-compose": ("NAME   IMAGE   COMMAND   SERVICE   STATUS       PORTS\na      i       c         web       Up 1 hour    80\nb      i       c         db        Exited (1)   ", "2 services (1 healthy, 1 unhealthy)", [["db", "Exited (1)", ""]]),
    "docker-ps": ("CONTAINER ID   IMAGE   STATUS       PORTS   NAMES\n1              i       Up 1 hour            a\n2              i       Exited (0)           b", "2 containers (1 running, 1 stopped)", [["a", "i", "Up 1 hour", ""]]),
    "package-list": ("Package Version\n------- -------\na       1.0\nb       2.0", "2 packages", [["a", "1.0"], ["b", "2.0"]]),
    "file-listing": (".\n├── a\n│   └── b.py\n└── c", "3 entries", [["a"], ["b.py"], ["c"]]),
    "search-results": ("a.py:1:x\na.py:2:y\nb.py:3:z", "3 matches across 2 files", [["a.py", "1", "x"], ["a.py", "2", "y"], ["b.py", "3", "z"]]),
    "gh-cli": ("Showing 2 of 30 open pull requests\n\n#1\tT\tfeat/a\tOPEN\n#2\tU\tfix/b\tDRAFT", "30 pull requests", [["1", "T", "feat/a", "OPEN"], ["2", "U", "fix/b", "DRAFT"]]),
    "env-redact": ("A=1\nB=2\nAPI_KEY=x\nC=3\nD=4", "5 vars (1 redacted)", [["A", "1"], ["B", "2"], ["API_KEY", "[REDACTED]"], ["C", "3"], ["D", "4"]]),
}


@pytest.mark.parametrize("tool", SAMPLES)
def test_detects_and_parses(tool):
    raw, summary, rows = SAMPLES[tool]
    found = E.detect(Text(raw))
    assert found is not None and found.tool == tool
    result = E.parse_output(raw)
    assert (result.tool, result.summary, result.rows) == (tool, summary, rows)


def test_docker_logs_by_hint():
    lines = [f"2025-01-01T00:00:{k:02d}Z {'ERROR x' if k == 25 else 'ok'}" for k in range(50)]
    result = E.parse_output("\n".join(lines), "docker-logs")
    assert result.summary == "50 log lines, 1 error"
    assert [r[0] for r in result.rows if r[0].startswith("...")] == ["... (13 lines skipped)", "... (12 lines skipped)"]
    assert E.detect(Text("\n".join(lines))).tool == "kubectl" and E.detect(Text("\n".join(lines[:30]))).tool == "search-results"


def test_never_longer_than_the_text():
    for raw, _, _ in SAMPLES.values():
        for verbose in (False, True):
            assert len(E.compact_output(raw, verbose=verbose)) <= len(raw)
    assert E.compact_output("") == "" and E.compact_output(None) == "" and E.compact_output("just words") == "just words"


def test_hints_and_ansi():
    assert E.compact_output("\x1b[31mred\x1b[0m") == "red"
    assert E.parse_output("no such thing", "pytest").tool == "pytest"
    assert E.parse_output(SAMPLES["tsc"][0], "unknown hint").tool == "tsc"
    assert E.parse_output("plain words") is None


def test_lint_groups():
    raw = "\n".join(f"{'ab'[k % 2]}.py:{k}:1: E501 long" for k in range(6)) + "\nc.py:1:1: F401 unused\nFound 7 errors."
    result = E.parse_output(raw)
    assert result.summary == "7 issues across 2 rules"
    assert result.rows[0] == ["", "", "", "E501", "6 occurrences", "2 files"] and result.rows[3] == ["... (4 more)", "", "", "", "", ""] and len(result.rows) == 5
    assert len(E.parse_output(raw, verbose=True).rows) == 7


def test_formatting():
    assert E.format_result(E.Result("t", "s", ["a", "b"], [["x;y", ""], ['say "q"', "[z]"]])) == '# t: s\n[a;b]\n"x;y";\nsay "q";"[z]"'
    assert E.format_result(E.Result("t", "s", ["a"], [], True)) == "# t (verbose): s"


def test_generic():
    lines = ["start of it"] + ["same"] * 3 + [f"{k}% done" for k in range(10)] + ["█████░░░"] + [f"line {'x' * (k % 9)} of text" for k in range(300)]
    out = generic_clean("\n".join(lines)).split("\n")
    assert out[:5] == ["start of it", "same (x3)", "0% done", "... (8 similar lines)", "9% done"]
    assert out[100] == "... (155 lines truncated, 305 total)" and len(out) == 151
    assert generic_clean("short\n\nshort") == "short\n\nshort"


def test_deep_trees_and_long_lists():
    # as in the format's other tools, the first two levels count as one
    tree = "├── a\n│   └── b\n│   │   └── c\n│   │   │   └── d\n│   │   │   │   ├── e.py\n│   │   │   │   └── f\n"
    assert E.parse_output(tree, "tree").rows == [["a"], ["b"], ["b/c"], ["b/c/d/ (1 files, 1 subdirs)"]]
    result = E.parse_output("\n".join(f"./{'ab'[k % 2]}/f{k}" for k in range(40)), "find")
    assert result.rows[3] == ["  ./a/ ... (17 more)"] and len(result.rows) == 8


def test_columns(spark):
    rows = spark.createDataFrame([(raw, None) for raw, _, _ in SAMPLES.values()] + [(None, None), ("", "git"), ("words", "nothing")], "text string, hint string")
    out = rows.select(E.parse_output_column(rows["text"], rows["hint"]).alias("p"), E.compact_output_column(rows["text"], rows["hint"]).alias("c"), E.detect_column(rows["text"]).alias("d")).collect()
    assert [r.d for r in out] == [*SAMPLES, None, None, None]
    assert [r.p and r.p.summary for r in out] == [s for _, s, _ in SAMPLES.values()] + [None] * 3
    assert out[-1].c == "words" and out[-3].c == ""


def test_exceptions_of_any_name():
    text = 'Traceback (most recent call last):\n  File "a.py", line 1, in f\n    x = 1\n        ^\npkg.errors.Halt: told\nmore of it\ndone\n'
    assert E.parse_output(text).rows == [["pkg.errors.Halt", "a.py", "1", "f", "told"]]
    assert E.parse_output('Traceback (most recent call last):\n  File "<s>", line 2, in <module>\nKeyboardInterrupt').rows == [["KeyboardInterrupt", "<s>", "2", "<module>", ""]]


def test_lines_that_only_resemble():
    assert E.parse_output("a.py:1: E501 no column", "ruff").rows == [] and E.parse_output("a.py:x:1: E501 bad", "ruff").rows == []
    assert E.parse_output("C:/x/a.py:3:4: PLR0913 many", "ruff").rows == [["C:/x/a.py", "3", "4", "PLR0913", "convention", "many"]]
    assert E.parse_output("note: m.py: error", "mypy").rows == []
    assert E.parse_output("m.py:3: error: Value [x] is bad", "mypy").rows == [["m.py", "3", "", "error", "", "Value [x] is bad"]]
    assert E.parse_output("FAILED t/a.py::TestX::test_y[1-2] - assert 0\n", "pytest").rows == []
    head = "=== short test summary info ===\nFAILED t/a.py::TestX::test_y[1-2] - assert 0 - 1\nERROR t/b.py - ImportError\n===== 2 failed ====="
    assert E.parse_output(head, "pytest").rows == [["test_y[1-2]", "FAILED", "t/a.py", "", "assert 0 - 1"], ["t/b.py", "ERROR", "t/b.py", "", "ImportError"]]
    assert E.parse_output("abc1234 (\nxyz", "git-blame").rows == [] and E.parse_output("stash@{x}: On main: m", "git-stash").rows == []
