"""Registry, detection, grouping, formatting, and the columns that compact outputs in DataFrames.

Parsers are tried in registration order; the best score of at least THRESHOLD wins, the earlier one on ties. A hint
names a parser outright. What no parser knows is cleaned as generic text. The result is never longer than the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.output import diagnostics, git, services, shell, testing
from lodestrata.functions.output.generic import generic_clean
from lodestrata.functions.output.reading import ANSI, Parser, Rows, Text, plural

THRESHOLD = 0.6
LINTERS = frozenset({"ruff", "eslint", "mypy", "pyright", "cargo-clippy", "tsc"})
KEPT, EXAMPLES = 3, 2
RESULT = "tool string, summary string, columns array<string>, rows array<array<string>>, verbose boolean"


@dataclass
class Result:
    tool: str
    summary: str
    columns: list[str]
    rows: Rows
    verbose: bool = False


PARSERS: list[Parser] = []
BY_HINT: dict[str, Parser] = {}


def register_parser(parser: Parser) -> None:
    """Later registrations take over hints; on ties of detection earlier ones win."""
    PARSERS.append(parser)
    BY_HINT.update(dict.fromkeys(map(str.lower, parser.hints), parser))


for _parser in (
    testing.PYTEST, testing.UNITTEST, diagnostics.RUFF, diagnostics.MYPY, diagnostics.PYRIGHT, diagnostics.PIP, diagnostics.TRACEBACK,
    testing.JEST, testing.VITEST, testing.MOCHA, diagnostics.TSC, diagnostics.ESLINT, diagnostics.WEBPACK, diagnostics.VITE, diagnostics.NPM,
    testing.CARGO_TEST, diagnostics.CARGO_BUILD, diagnostics.CARGO_CLIPPY, diagnostics.DOCKER,
    git.GIT_DIFF, git.GIT_STATUS, git.GIT_LOG, git.GIT_SHOW, git.GIT_BLAME, git.GIT_BRANCH, git.GIT_STASH,
    services.KUBECTL, services.DOCKER_COMPOSE, services.DOCKER_PS, services.DOCKER_LOGS,
    shell.PACKAGE_LIST, shell.FILE_LISTING, shell.SEARCH_RESULTS, shell.GH_CLI, shell.ENV_REDACT,
):
    register_parser(_parser)


def detect(text: Text) -> Parser | None:
    scored = [(p.detect(text), -k, p) for k, p in enumerate(PARSERS)]
    score, _, best = max(scored, key=lambda x: x[:2])
    return best if score >= THRESHOLD else None


def choose(text: Text, hint: str | None) -> Parser | None:
    return (BY_HINT.get(hint.lower()) if hint else None) or detect(text)


def group_by_rule(result: Result) -> Result:
    """A linter's findings by rule, in order of appearance; of rules with many findings a header, examples, a count."""
    at = next((k for k, name in enumerate(result.columns) if name in ("rule", "code")), None)
    if result.verbose or result.tool not in LINTERS or at is None or not result.rows:
        return result
    by: dict[str, Rows] = {}
    for row in result.rows:
        by.setdefault(row[at], []).append(row)
    rows: Rows = []
    for rule, found in by.items():
        if len(found) <= KEPT:
            rows += found
            continue
        files = list(dict.fromkeys(r[0] for r in found))
        told = [""] * at + [rule, f"{len(found)} occurrences", files[0] if len(files) == 1 else f"{len(files)} files"]
        width = len(result.columns)
        rows += [(told + [""] * width)[:width], *found[:EXAMPLES], [f"... ({len(found) - EXAMPLES} more)"] + [""] * (width - 1)]
    return Result(result.tool, f"{plural(len(result.rows), 'issue')} across {plural(len(by), 'rule')}", result.columns, rows)


def _cell(value: str) -> str:
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ";{}[]\n") else value


def format_result(result: Result) -> str:
    head = f"# {result.tool}{' (verbose)' * result.verbose}: {result.summary}"
    if not result.rows:
        return head
    return "\n".join([head, f"[{';'.join(result.columns)}]", *(";".join(map(_cell, row)) for row in result.rows)])


def parse_output(raw: str | None, hint: str | None = None, verbose: bool = False) -> Result | None:
    """The parsed table; None for blank text and for what no parser knows."""
    if not raw or not raw.strip():
        return None
    text = Text(raw)
    parser = choose(text, hint)
    return group_by_rule(Result(parser.tool, *parser.parse(text, verbose), verbose)) if parser else None


def compact_output(raw: str | None, hint: str | None = None, verbose: bool = False) -> str:
    if not raw or not raw.strip():
        return ""
    plain = ANSI.sub("", raw)
    result = parse_output(raw, hint, verbose)
    out = format_result(result) if result else generic_clean(raw)
    return out if len(out) <= len(plain) else plain


def _each(f: Callable, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(texts: pd.Series, hints: pd.Series, verbose: pd.Series) -> pd.Series:
        return pd.Series([f(t, h, bool(v)) for t, h, v in zip(texts, hints, verbose, strict=True)], dtype=object)

    return run


def _hint(hint: Column | str | None) -> Column:
    return F.lit(hint).cast("string") if hint is None or isinstance(hint, str) else hint


def compact_output_column(text: Column, hint: Column | str | None = None, verbose: bool = False) -> Column:
    return _each(compact_output, T.StringType())(text, _hint(hint), F.lit(verbose))


def parse_output_column(text: Column, hint: Column | str | None = None, verbose: bool = False) -> Column:
    """The parsed table as a struct, null where no parser knows the text."""
    kind = T._parse_datatype_string(RESULT)

    @F.pandas_udf(kind)
    def run(texts: pd.Series, hints: pd.Series) -> pd.DataFrame:
        found = [parse_output(t, h, verbose) for t, h in zip(texts, hints, strict=True)]
        return pd.DataFrame([(None,) * 5 if r is None else (r.tool, r.summary, r.columns, r.rows, r.verbose) for r in found], columns=kind.names)

    return run(text, _hint(hint))


def detect_column(text: Column) -> Column:
    """The detected tool's name, else null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        found = (detect(Text(t)) if t and t.strip() else None for t in texts)
        return pd.Series([p.tool if p else None for p in found], dtype=object)

    return run(text)
