"""Definitions, calls, imports and route hints of source files.

Python files go through the standard library's parser; JavaScript and TypeScript through a tokenizer that follows
braces. A file that cannot be parsed gives no rows but an error. Names that repeat, null contents and empty files
are allowed; order is a column.
"""

from __future__ import annotations

import ast
import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.workspace import map_rows

# Verbs that make routes.
VERBS = frozenset({"get", "post", "put", "delete", "patch", "head", "options", "all"})
_METHOD = re.compile(r"""\.(?i:(get|post|put|delete|patch|head|options|all))\s*\(\s*["']([^"']+)["']""")
_ROUTE, _METHODS, _ITEM = re.compile(r"""\.route\s*\(\s*["']([^"']+)["']"""), re.compile(r"methods\s*=\s*\[([^\]]+)\]"), re.compile(r"""["'](\w+)["']""")
_NEST = re.compile(r"""@(?i:(Get|Post|Put|Delete|Patch|Head|Options|All))\s*\(\s*(?:["']([^"']*?)["'])?\s*\)""")

DEFINITION = "project string, rel_path string, ord long, name string, qualified_name string, label string, line_start int, line_end int"
CALL = "project string, rel_path string, ord long, callee string, line int, caller_qn string"
IMPORT = "project string, rel_path string, ord long, module_path string, alias string, names array<string>, line int"
HINT = "project string, rel_path string, ord long, def_qn string, handler_name string, route_path string, route_method string, line int"


def decorator_routes(text: str) -> list[tuple[str, str]]:
    """(METHOD, path) pairs of a decorator: .get("/x"), .route("/x", methods=[...]), @Get("/x")."""
    if m := _METHOD.search(text):
        return [(m[1].upper(), m[2])]
    if m := _ROUTE.search(text):
        methods = _METHODS.search(text)
        return [(item.upper(), m[1]) for item in _ITEM.findall(methods[1])] if methods else [("GET", m[1])]
    m = _NEST.search(text)
    return [(m[1].upper(), m[2] or "/")] if m else []


@dataclass
class Found:
    project: str
    rel_path: str
    definitions: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    imports: list[tuple] = field(default_factory=list)
    hints: list[tuple] = field(default_factory=list)
    scope: list[str] = field(default_factory=list)
    types: set[str] = field(default_factory=set)

    def qn(self, name: str | None = None) -> str:
        return "::".join([self.project, self.rel_path, ".".join([*self.scope, *([name] if name else [])])])

    def define(self, name: str, kind: str, start: int, end: int) -> str:
        """A function directly inside a known type is a method; types are remembered by name."""
        if kind == "Function" and self.scope and self.scope[-1] in self.types:
            kind = "Method"
        elif kind not in ("Function", "Method"):
            self.types.add(name)
        self.definitions.append((name, self.qn(name), kind, start, end))
        return self.qn(name)

    def call(self, callee: str, line: int) -> None:
        self.calls.append((callee, line, self.qn() if self.scope else None))


_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|\Z)")


class _Python(ast.NodeVisitor):
    """Lines are cut and encoded once, so that a node's text costs its own length, wherever it stands."""

    def __init__(self, found: Found, source: str):
        self.found, self.lines = found, [line.encode() for line in _LINE.findall(source)]

    def _text(self, node) -> str:
        """The source of a node: its columns are bytes of UTF-8."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode()
        return b"".join([self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]]).decode()

    def _scoped(self, node, kind: str) -> None:
        qn = self.found.define(node.name, kind, node.lineno, node.end_lineno)
        if kind == "Function":
            for decorator in node.decorator_list:
                for method, path in decorator_routes("@" + self._text(decorator)):
                    self.found.hints.append((qn, node.name, path, method, node.lineno))
        self.found.scope.append(node.name)
        for name, value in ast.iter_fields(node):
            if name != "decorator_list":
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.AST):
                        self.visit(child)
        self.found.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        self._scoped(node, "Function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self._scoped(node, "Class")

    def visit_Call(self, node) -> None:
        f = node.func
        callee = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else self._text(f).rsplit(".", 1)[-1]
        self.found.call(callee, node.lineno)
        self.generic_visit(node)

    def visit_Name(self, node) -> None:
        """Nothing is inside a name or a constant."""

    visit_Constant = visit_Name

    def visit_Import(self, node) -> None:
        self.found.imports.append((self._text(node), None, [], node.lineno))

    def visit_ImportFrom(self, node) -> None:
        names = [a.name if a.asname is None else f"{a.name} as {a.asname}" for a in node.names if a.name != "*"]
        self.found.imports.append(("." * node.level + (node.module or ""), None, names, node.lineno))


_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$#][\w$]*)|(?P<number>\d[\w.]*)|(?P<arrow>=>|\?\.|\.\.\.)|(?P<mark>.)""",
    re.S,
)
_NO_CALL = frozenset("if for while switch catch return typeof await function super import new constructor with do else case in of yield void delete throw".split())
_TYPES = {"class": "Class", "interface": "Interface", "enum": "Enum", "namespace": "Class", "module": "Class"}


@dataclass
class _Token:
    kind: str
    text: str
    line: int


def _tokens(source: str) -> list[_Token]:
    out, line = [], 1
    for m in _TOKEN.finditer(source):
        if m.lastgroup != "space":
            out.append(_Token(m.lastgroup, m[0], line))
        line += m[0].count("\n")
    return out


class _Script:
    """A walk over tokens with a stack of what each open brace belongs to."""

    def __init__(self, found: Found, source: str, typed: bool):
        self.found, self.typed, self.t = found, typed, _tokens(source)
        self.braces: list[tuple[str, int] | None] = []  # the scope's kind and its definition's index
        self.waiting: tuple[str, int] | None = None  # a scope whose brace is still to come
        self.depth = 0  # of parentheses since the scope was announced
        self.pending: list[str] = []  # decorators before a definition

    def text(self, k: int) -> str:
        return self.t[k].text if 0 <= k < len(self.t) else ""

    def kind(self, k: int) -> str:
        return self.t[k].kind if 0 <= k < len(self.t) else ""

    def closing(self, k: int, opening: str = "(", ending: str = ")") -> int:
        depth = 0
        for j in range(k, len(self.t)):
            depth += (self.text(j) == opening) - (self.text(j) == ending)
            if depth == 0:
                return j
        return len(self.t) - 1

    def announce(self, name: str, kind: str, k: int) -> None:
        line = self.t[k].line
        qn = self.found.define(name, kind, line, line)
        if kind == "Function":
            for said in self.pending:
                for method, path in decorator_routes(said):
                    self.found.hints.append((qn, name, path, method, line))
        self.pending = []
        self.waiting, self.depth = (name, len(self.found.definitions) - 1), 0

    def run(self) -> None:
        k = 0
        while k < len(self.t):
            k = self.step(k)

    def _brace(self, k: int) -> None:
        if self.text(k) == "{":
            opens = self.waiting if self.depth == 0 else None
            self.braces.append(opens)
            if opens:
                self.found.scope.append(opens[0])
                self.waiting = None
        elif self.braces:
            closed = self.braces.pop()
            if closed:
                self.found.scope.pop()
                row = self.found.definitions[closed[1]]
                self.found.definitions[closed[1]] = (*row[:4], self.t[k].line)

    def step(self, k: int) -> int:
        token = self.t[k]
        if token.text in ("{", "}"):
            self._brace(k)
        elif token.text in ("(", ")"):
            self.depth += 1 if token.text == "(" else -1
        elif token.text == ";" and self.waiting and self.depth == 0:
            self.waiting = None
        elif token.text == "@" and self.kind(k + 1) == "name":
            end = k + 1
            while self.text(end + 1) == "." and self.kind(end + 2) == "name":
                end += 2
            if self.text(end + 1) == "(":
                end = self.closing(end + 1)
            self.pending.append("".join(x.text for x in self.t[k : end + 1]))
            return end + 1
        elif token.kind == "name":
            return self._name(k)
        return k + 1

    def _name(self, k: int) -> int:
        word, after = self.text(k), self.text(k + 1)
        member = self.text(k - 1) in (".", "?.")
        if not member and word == "import" and after not in ("(", "."):
            return self._import(k)
        if not member and word in ("const", "let", "var") and self._requires(k):
            return k + 1
        if not member and word == "function":
            at = k + 2 if after == "*" else k + 1
            if self.kind(at) == "name":
                self.announce(self.text(at), "Function", k)
                return at + 1
            return k + 1
        if not member and word in _TYPES and self.kind(k + 1) == "name" and (self.typed or word == "class") and self.text(k - 1) not in (".", ":"):
            self.announce(after, _TYPES[word], k)
            return k + 2
        if self.typed and not member and word == "type" and self.kind(k + 1) == "name" and self.text(k + 2) in ("=", "<"):
            self.found.define(after, "Class", self.t[k].line, self.t[k].line)
            return k + 2
        if after == "(" and not member and self._is_method(k):
            self.announce(word, "Function", k)
            return k + 1
        if after == "(" and word not in _NO_CALL:
            self.found.call(word, self.t[k].line)
            if member and word.lower() in VERBS:
                self._route(k)
        return k + 1

    def _is_method(self, k: int) -> bool:
        """A name with parameters, then a body, directly inside a type."""
        inside = bool(self.braces) and self.braces[-1] is not None and self.found.scope and self.found.scope[-1] in self.found.types
        if not inside or self.text(k) in _NO_CALL - {"constructor", "get", "set", "delete"} or self.text(k - 1) in (".", "new", "=", "("):
            return False
        j = self.closing(k + 1) + 1
        if self.text(j) == ":" and self.typed:
            while j < len(self.t) and self.text(j) not in ("{", ";", "}", "="):
                j += 1
            return self.text(j) in ("{", ";")
        return self.text(j) == "{" or (self.typed and self.text(j) == ";")

    def _route(self, k: int) -> None:
        """app.get("/path", handler)"""
        if self.kind(k + 2) == "text" and self.text(k + 2)[1:2] == "/":
            handler, at = "", k + 4
            if self.text(k + 3) == "," and self.kind(at) == "name":
                while self.text(at + 1) == "." and self.kind(at + 2) == "name":
                    at += 2
                handler = self.text(at) if self.text(at + 1) in (",", ")") else ""
            self.found.hints.append(("", handler, self.text(k + 2).strip("\"'`"), self.text(k).upper(), self.t[k].line))

    def _import(self, k: int) -> int:
        names, j = [], k + 1
        while j < len(self.t) and self.kind(j) != "text" and self.text(j) != ";":
            if self.kind(j) == "name" and self.text(j) not in ("from", "as", "type") and self.text(j + 1) != "as":
                names.append(self.text(j))
            j += 1
        if self.kind(j) == "text":
            self.found.imports.append((self.text(j).strip("\"'`"), None, names, self.t[k].line))
        return j + 1

    def _requires(self, k: int) -> bool:
        """const x = require('y'), const { a, b } = require('y')"""
        end = self.closing(k + 1, "{", "}") if self.text(k + 1) == "{" else k + 1
        if self.text(end + 1) != "=" or self.text(end + 2) != "require" or self.kind(end + 4) != "text":
            return False
        names = [self.text(j) for j in range(k + 1, end + 1) if self.kind(j) == "name"]
        self.found.imports.append((self.text(end + 4).strip("\"'`"), None, names, self.t[k].line))
        return True


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the cycle collector: trees and tokens of a long file are very many objects, which it would walk again
    and again, and have no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def extract(source: str | None, language: str, project: str, rel_path: str) -> Found:
    """Raises SyntaxError for Python files that do not parse."""
    found = Found(project, rel_path)
    with _uncollected():
        if language == "Python":
            _Python(found, source or "").visit(ast.parse(source or ""))
        else:
            _Script(found, source or "", language in ("TypeScript", "Tsx")).run()
    return found


_KINDS = {"definitions": DEFINITION, "calls": CALL, "imports": IMPORT, "hints": HINT}
_STRUCT = lambda ddl: "array<struct<" + ",".join(":".join(x.split(" ")) for x in ddl.split(", ")[2:]) + ">>"
EXTRACTED = "project string, rel_path string, error string, " + ", ".join(f"{k} {_STRUCT(ddl)}" for k, ddl in _KINDS.items())
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
#: Files are put out together up to so many files, definitions, calls, imports and hints; a file of more goes alone.
ROWS_OUT = 20_000


def _arrays(ddl: str, files: list[list[tuple]]) -> pa.ListArray:
    """For each file the array of its rows of one kind, numbered from 0."""
    fields = [pa.field(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in ddl.split(", ")[2:])]
    columns = [[n for rows in files for n in range(len(rows))], *([row[k] for rows in files for row in rows] for k in range(len(fields) - 1))]
    each = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(accumulate(map(len, files), initial=0), pa.int32()), each)


def _batch(found: list[Found], errors: list[str | None]) -> pa.RecordBatch:
    plain = [pa.array(x, pa.string()) for x in ([f.project for f in found], [f.rel_path for f in found], errors)]
    return pa.RecordBatch.from_arrays([*plain, *(_arrays(ddl, [getattr(f, kind) for f in found]) for kind, ddl in _KINDS.items())], ["project", "rel_path", "error", *_KINDS])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, errors, held = [], [], 0
    for files in batches:
        for project, rel_path, language, content in zip(*files.columns, strict=True):
            one, error = Found(project.as_py(), rel_path.as_py()), None
            try:
                one = extract(content.as_py(), language.as_py(), one.project, one.rel_path)
            except (SyntaxError, ValueError, RecursionError) as wrong:
                error = f"{type(wrong).__name__}: {wrong}"
            rows = 1 + sum(len(getattr(one, kind)) for kind in _KINDS)
            if found and held + rows > ROWS_OUT:
                yield _batch(found, errors)
                found, errors, held = [], [], 0
            found.append(one)
            errors.append(error)
            held += rows
    if found:
        yield _batch(found, errors)


def extracted(files: DataFrame) -> DataFrame:
    """One row a file with arrays of definitions, calls, imports, hints; error tells why a file has none."""
    return map_rows(files.select("project", "rel_path", "language", "content"), _rows, EXTRACTED)


def exploded(found: DataFrame, kind: str) -> DataFrame:
    """project, rel_path and the rows of one kind, with ord within the file."""
    return found.select("project", "rel_path", F.inline(kind))
