"""Unknown output: without progress bars, repeats and long middles."""

from __future__ import annotations

import re
from itertools import groupby

from lodestrata.functions.output.reading import ANSI

# Limits and characters that results depend on.
SHORT, LONGEST, HEAD, TAIL, SIMILAR = 500, 200, 100, 50, 5
SPINNERS = frozenset("⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏⣾⣽⣻⢿⡿⣟⣯⣷")
NO_BARS = re.compile(r"[^━█▓░▒■□●○#=\->{}/|]+")
RATES = re.compile(r"%|B/s|ETA|--:--:--|\d+:\d+:\d+")
DIGITS, NO_DIGITS = re.compile(r"\d+"), re.compile(r"\D+")


def is_progress(line: str) -> bool:
    bare = line.strip()
    return bool(bare) and (not SPINNERS.isdisjoint(bare) or 2 * len(NO_BARS.sub("", bare)) >= len(bare))


def numeric_heavy(line: str) -> bool:
    bare = line.strip()
    return bool(bare) and (bool(RATES.search(bare)) or len(NO_DIGITS.sub("", bare)) >= 0.3 * len(bare))


def once_each(lines: list[str]) -> list[str]:
    out = []
    for line, run in groupby(lines):
        n = sum(1 for _ in run)
        out += [f"{line} (x{n})"] if n > 1 and line.strip() else [line] * n
    return out


def fold_similar(lines: list[str]) -> list[str]:
    """Runs that differ in digits only, from their first numeric-heavy line on."""
    out = []
    for _, group in groupby(lines, key=lambda line: DIGITS.sub("N", line)):
        run = list(group)
        start = next((k for k, line in enumerate(run) if numeric_heavy(line)), len(run))
        tail = run[start:]
        out += run[:start]
        out += tail if len(tail) < SIMILAR else [tail[0], f"... ({len(tail) - 2} similar lines)", tail[-1]]
    return out


def cut_middle(lines: list[str]) -> list[str]:
    if len(lines) <= LONGEST:
        return lines
    return [*lines[:HEAD], f"... ({len(lines) - HEAD - TAIL} lines truncated, {len(lines)} total)", *lines[-TAIL:]]


def generic_clean(text: str | None) -> str:
    """Short text only loses its ANSI codes."""
    if not text or not text.strip():
        return ""
    plain = ANSI.sub("", text)
    if len(plain) < SHORT:
        return plain
    return "\n".join(cut_middle(fold_similar(once_each([x for x in plain.splitlines() if not is_progress(x)]))))
