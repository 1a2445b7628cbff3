"""What parsers share: a text with its lines, blocks between headings, tables by column, shortened lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from typing import TypeVar

ANSI = re.compile(r"\x1b\[[0-9;]*[a-zA-Z]")
TEST_COLUMNS = ["test", "status", "file", "line", "error"]
Rows = list[list[str]]
Told = tuple[str, list[str], Rows]  # summary, columns, rows
T = TypeVar("T")


class Text:
    """A command's output without ANSI codes."""

    def __init__(self, raw: str):
        self.all = ANSI.sub("", raw)

    @cached_property
    def lines(self) -> list[str]:
        return self.all.splitlines()

    @cached_property
    def bare(self) -> list[str]:
        return [line.strip() for line in self.lines]

    @cached_property
    def full(self) -> list[str]:
        """Lines that are not blank."""
        return [line for line in self.lines if line.strip()]

    @cached_property
    def words(self) -> list[str]:
        return self.all.split()

    def counts(self, *phrase: str | None) -> list[int] | None:
        """The numbers in the first run of words that fits phrase, in which None stands for a number and a word for
        any that starts with it; None without one."""
        if not all(p in self.all for p in phrase if p):
            return None
        for at in range(len(self.words) - len(phrase) + 1):
            said = self.words[at : at + len(phrase)]
            if all(w.isdecimal() if p is None else w.startswith(p) for p, w in zip(phrase, said, strict=True)):
                return [int(w) for p, w in zip(phrase, said, strict=True) if p is None]
        return None

    def says(self, *words: str) -> bool:
        """Whether one of these stands in the text, in whatever case."""
        low = self.all.lower()
        return any(w in low for w in words)

    def each(self, read: Callable[[str], T | None], bare: bool = False, first: int | None = None) -> list[T]:
        """What read makes of the lines that it understands."""
        return [found for line in (self.bare if bare else self.lines)[:first] if (found := read(line)) is not None]


@dataclass(frozen=True)
class Parser:
    tool: str
    hints: tuple[str, ...]
    detect: Callable[[Text], float]
    parse: Callable[[Text, bool], Told]


def located(place: str, numbers: int = 2) -> list[str] | None:
    """['path', '12', '3'] for 'path:12:3': the path and up to so many numbers that end it, missing ones as ''."""
    found: list[str] = []
    while len(found) < numbers:
        before, colon, last = place.rpartition(":")
        if not (colon and last.isdecimal()):
            break
        place, found = before, [last, *found]
    return [place, *found, *[""] * (numbers - len(found))] if place.strip() and found else None


def ended(text: str, opening: str, closing: str) -> tuple[str, str]:
    """(rest, note) of a text that ends with a note in such brackets, else (text, '')."""
    rest, found, note = text.rpartition(" " + opening)
    return (rest.rstrip(), note[:-1]) if found and note.endswith(closing) and len(note) > 1 else (text, "")


def plural(n: int, word: str, ending: str = "s") -> str:
    return f"{n} {word}{ending if n != 1 else ''}"


def blocks(lines: Iterable[str], start: Callable[[str], T | None]) -> list[tuple[T, list[str]]]:
    """What start makes of each line that it takes for a heading, with the lines up to the next one."""
    out: list[tuple[T, list[str]]] = []
    for line in lines:
        if (heading := start(line)) is not None:
            out.append((heading, []))
        elif out:
            out[-1][1].append(line)
    return out


def first_of(lines: Iterable[str], *not_before: str) -> str:
    """The first line, stripped, that is not blank and starts with none of the given words."""
    return next((s for line in lines if (s := line.strip()) and not s.startswith(not_before or ("\0",))), "")


def columns_of(header: str) -> list[tuple[str, int, int | None]]:
    """(name, start, end) of each word of a header line."""
    found = [(m[0].lower(), m.start()) for m in re.finditer(r"\S+", header)]
    return [(name, at, found[k + 1][1] if k + 1 < len(found) else None) for k, (name, at) in enumerate(found)]


def table_rows(header: str, lines: Iterable[str], rules: bool = False) -> list[dict[str, str]]:
    """Rows cut at the header's word starts; a later column of the same name stands for the earlier. rules: lines of
    dashes are left out."""
    columns = columns_of(header)
    return [{name: line[a:b].strip() for name, a, b in columns} for line in lines if line.strip() and not (rules and re.fullmatch(r"[-\s]+", line.strip()))]


def head_and_more(rows: Rows, most: int, shown: int) -> Rows:
    """rows, or if there are over most of them the first ones and a row that counts the rest."""
    if len(rows) <= most:
        return rows
    return [*rows[:shown], [f"... ({len(rows) - shown} more)"] + [""] * (len(rows[0]) - 1)]


def around(lines: list[str], hit: Callable[[str], bool], head: int, tail: int, context: int) -> list[str]:
    """The head, the tail and what stands near hits, with markers for the lines between."""
    n = len(lines)
    keep = set(range(min(head, n))) | set(range(max(0, n - tail), n))
    for i, line in enumerate(lines):
        if hit(line):
            keep |= set(range(max(0, i - context), min(n, i + context + 1)))
    out, last = [], -1
    for i in sorted(keep):
        if i > last + 1:
            out.append(f"... ({plural(i - last - 1, 'line')} skipped)")
        out.append(lines[i])
        last = i
    return out
