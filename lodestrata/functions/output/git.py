"""git: diffs, status, history, blame, branches, stashes."""

from __future__ import annotations

from collections import Counter
from itertools import groupby

from lodestrata.functions.output.reading import Parser, Rows, Text, Told, blocks, first_of, plural

DIFF = ["file", "lines_changed", "content"]
CONTEXT, HUNK_LIMIT, DIR_LIMIT, LOG_LIMIT, BRANCH_LIMIT = 3, 50, 8, 10, 20
STASH_LIMIT, STASH_HEAD, STASH_TAIL = 10, 5, 2
# Files whose changes are only counted.
LOCK_FILES = (
    "package-lock.json",
    "yarn.lock",
    "pnpm-lock.yaml",
    "Cargo.lock",
    "poetry.lock",
    "uv.lock",
    "go.sum",
    "Gemfile.lock",
    "composer.lock",
    "Pipfile.lock",
)
HEX = set("0123456789abcdef")


def _is_hash(word: str, least: int = 7, most: int = 40) -> bool:
    return least <= len(word) <= most and set(word) <= HEX


def _starts_diff(line: str) -> bool:
    return line.startswith("diff --git a/")


def _diff_path(line: str) -> str | None:
    """The new path of 'diff --git a/old b/new'."""
    return line.rpartition(" b/")[2] if _starts_diff(line) and " b/" in line else None


def _hunk_head(line: str) -> str | None:
    return line if line.startswith("@@ ") and " @@" in line[3:] else None


def _is_meta(line: str) -> bool:
    """Lines between a file's heading and its first hunk."""
    return line.startswith(("index ", "--- ", "+++ ")) or line.split(" ")[:2] in (["old", "mode"], ["new", "mode"], ["deleted", "file"], ["new", "file"])


def _stat(line: str) -> tuple[str, int] | None:
    """Path and number of 'path | 3 ++-'."""
    path, bar, said = line.rpartition("|")
    number, _, marks = said.strip().partition(" ")
    return (path.strip(), int(number)) if bar and path.strip() and number.isdecimal() and set(marks) <= set("+- ") else None


def _commit(line: str) -> str | None:
    word, _, name = line.partition(" ")
    return name if word == "commit" and _is_hash(name, 40) else None


def _is_commit_meta(line: str) -> bool:
    return line.startswith(("Author:", "Date:", "Merge:")) and line.partition(":")[2][:1].isspace()


def _hunk(lines: list[str]) -> tuple[list[str], int]:
    """A hunk's changed lines with CONTEXT unchanged ones around, up to HUNK_LIMIT changes; the number of all changes."""
    changed = [k for k, line in enumerate(lines) if line[:1] in ("+", "-")]
    cut = changed[HUNK_LIMIT - 1] if len(changed) >= HUNK_LIMIT else None
    keep: set[int] = set()
    for k in changed[:HUNK_LIMIT]:
        keep |= set(range(max(0, k - CONTEXT), min(len(lines), k + CONTEXT + 1)))
    out = [lines[k] for k in sorted(keep) if cut is None or k <= cut]
    return out + ["... (truncated after 50 changed lines)"] * (cut is not None), len(changed)


def _diff_file(path: str, body: list[str]) -> tuple[str, int, str]:
    if path.split("/")[-1] in LOCK_FILES:
        n = sum(line.startswith("+") and not line.startswith("+++") for line in body)
        return path, n, f"(lockfile changed, {n} lines)"
    said: list[str] = []
    total = 0
    for head, lines in blocks((line for line in body if not _is_meta(line)), _hunk_head):
        kept, n = _hunk(lines)
        if said and not said[-1].startswith("@@"):
            said.append("")
        said += [head, *kept]
        total += n
    return path, total, "\n".join(said)


def _diff_rows(lines: list[str]) -> list[tuple[str, int, str]]:
    return [_diff_file(path, body) for path, body in blocks(lines, _diff_path)]


def _changes(rows: list[tuple[str, int, str]]) -> str:
    return f"{plural(len(rows), 'file')}, {sum(n for _, n, _ in rows)} changes"


def _as_rows(found: list[tuple[str, int, str]]) -> Rows:
    return [[path, str(n), said] for path, n, said in found]


def _diff_score(t: Text) -> float:
    score = 0.6 * any(map(_starts_diff, t.lines)) + 0.3 * any(map(_hunk_head, t.lines))
    return score or 0.7 * (len(t.each(_stat)) >= 2)


def _diff(t: Text, verbose: bool) -> Told:
    if any(map(_starts_diff, t.lines)):
        found = _diff_rows(t.lines)
    else:
        found = [(path, n, f"{n} changes") for path, n in t.each(_stat)]
    return _changes(found) if found else "no changes", DIFF, _as_rows(found)


def _show_score(t: Text) -> float:
    return {2: 0.9, 1: 0.4, 0: 0.0}[any(map(_commit, t.lines)) + any(map(_starts_diff, t.lines))]


def _show(t: Text, verbose: bool) -> Told:
    start = next((k for k, line in enumerate(t.lines) if _starts_diff(line)), len(t.lines))
    head = t.lines[:start]
    commits = [name[:8] for line in head if (name := _commit(line))]
    other = [line for line in head if not _commit(line) and not _is_commit_meta(line)]
    blank = next((k for k, line in enumerate(other) if not line.strip()), len(other))
    commit, said = commits[-1] if commits else "", first_of(other[blank:])
    found = _diff_rows(t.lines[start:])
    told = f"{commit}: {said}" if commit and said else commit or (_changes(found) if found else "no changes")
    return told + (f" — {_changes(found)}" if found else ""), DIFF, _as_rows(found)


# status
# Words of the long form, letters of the short one, sections.
LONG = ("modified", "new file", "deleted", "renamed", "copied", "unmerged")
_LETTERS = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "U": "unmerged"}
_SECTIONS = {"Changes to be committed": "staged", "Changes not staged": "unstaged", "Untracked files": "untracked"}


def _long_status(line: str) -> tuple[str, str] | None:
    """(kind, path) of an indented 'kind:   path'."""
    kind, colon, path = line.removeprefix("\t").partition(":")
    return (kind, path.strip()) if line.startswith("\t") and colon and kind in LONG and path.strip() else None


def _short_status(line: str) -> tuple[str, str] | None:
    """(two letters, path)."""
    return (line[:2], line[3:].strip()) if len(line) > 3 and set(line[:2]) <= {*_LETTERS, "?", "!", " "} and line[2].isspace() and line[3:].strip() else None


def _status_score(t: Text) -> float:
    said = 0.5 * any("On branch" in x for x in t.lines) + 0.3 * any("nothing to commit" in x for x in t.lines)
    return min(1.0, said + 0.4 * any(map(_long_status, t.lines)) + 0.5 * (len(t.each(_short_status)) >= 2))


def _status_long(lines: list[str]) -> Rows:
    rows: Rows = []
    section = ""
    for line in lines:
        if named := next((s for start, s in _SECTIONS.items() if line.startswith(start)), None):
            section = named
        elif section == "untracked":
            if (path := line.strip()) and not path.startswith("("):
                rows.append([path, "untracked", "false"])
        elif found := _long_status(line):
            rows.append([found[1], found[0], "true" if section == "staged" else "false"])
    return rows


def _status_short(found: list[tuple[str, str]]) -> Rows:
    rows: Rows = []
    for (staged, unstaged), path in found:
        if staged == unstaged == "?":
            rows.append([path, "untracked", "false"])
        elif staged in _LETTERS:
            rows.append([path, _LETTERS[staged], "true"])
        elif unstaged in _LETTERS:
            rows.append([path, _LETTERS[unstaged], "false"])
    return rows


def _kinds(rows: Rows, order: str) -> str:
    """'M:3, A:1': counts by kind, in the order of its letters."""
    counts = Counter("?" if r[1] == "untracked" else r[1][0].upper() if r[1][0].upper() in "MAD" else "O" for r in rows)
    return ", ".join(f"{k}:{counts[k]}" for k in order if counts[k])


def _status(t: Text, verbose: bool) -> Told:
    short = t.each(_short_status)
    rows = _status_short(short) if short else _status_long(t.lines) if any(map(_long_status, t.lines)) else []
    summary = f"Files: {len(rows)} ({_kinds(rows, 'MAD?O')})" if rows else "Working tree clean"
    top = lambda r: r[0].split("/")[0]
    out = [r for r in rows if "/" not in r[0]]
    for folder, inside in groupby(sorted((r for r in rows if "/" in r[0]), key=top), key=top):
        members = list(inside)
        out += members if len(members) <= DIR_LIMIT else [[f"{folder}/", f"({len(members)} files: {_kinds(members, 'MAD?')})", ""]]
    return summary, ["file", "status", "staged"], out


# log
def _oneline(line: str) -> list[str] | None:
    name, _, said = line.partition(" ")
    return [name[:8], said.strip()] if _is_hash(name) and said.strip() else None


def _log_score(t: Text) -> float:
    score = 0.6 * any(map(_commit, t.lines)) + 0.3 * any(map(_is_commit_meta, t.lines))
    return score or 0.5 * (len(t.each(_oneline)) >= 2)


def _message(body: list[str]) -> str:
    """The first line of text after the blank line that ends a commit's head."""
    rest = [line for line in body if not _is_commit_meta(line)]
    blank = next((k for k, line in enumerate(rest) if not line.strip()), len(rest))
    return first_of(rest[blank:])


def _log(t: Text, verbose: bool) -> Told:
    if any(map(_commit, t.lines)):
        rows = [[name[:8], _message(body)] for name, body in blocks(t.lines, _commit)]
    else:
        rows = t.each(_oneline, bare=True)
    n = len(rows)
    told = plural(n, "entr", "ies") if n != 1 else "1 entry"
    return told if n <= LOG_LIMIT else f"{LOG_LIMIT} entries (showing {LOG_LIMIT} of {n})", ["hash", "message"], rows[:LOG_LIMIT]


# blame
def _blamed(line: str) -> tuple[str, str, int] | None:
    """(commit, author, line) of 'commit [path] (author  date time zone line) text'."""
    before, opened, rest = line.removeprefix("^").partition("(")
    inside, closed, _ = rest.partition(")")
    words = inside.split()
    if not (opened and closed and len(words) > 4 and before.split() and _is_hash(before.split()[0], 7, 8) and words[-1].isdecimal()):
        return None
    date = words[-4]
    is_date = len(date) == 10 and date[4] == date[7] == "-" and date.replace("-", "").isdecimal()
    return (before.split()[0], inside[: inside.rindex(date)].strip(), int(words[-1])) if is_date else None


def _blame(t: Text, verbose: bool) -> Told:
    lines = t.each(_blamed)
    rows: Rows = []
    for (commit, author), run in groupby(lines, key=lambda x: x[:2]):
        numbers = [x[2] for x in run]
        rows.append([str(numbers[0]) if numbers[0] == numbers[-1] else f"{numbers[0]}-{numbers[-1]}", commit, author])
    told = f"{len(lines)} lines, {plural(len({r[2] for r in rows}), 'author')}, {plural(len(rows), 'range')}"
    return told if rows else "0 lines", ["lines", "hash", "author"], rows


# branch
def _is_branch(line: str) -> bool:
    """A mark or white space, white space, a name."""
    words = line.replace("*", " ", 1).split()
    return line[:1] in ("*", " ", "\t") and line[1:2].isspace() and bool(words) and (words[0][0].isalnum() or words[0][0] in "_./@-")


def _branch_row(line: str) -> list[str] | None:
    words = line.lstrip("* ").strip().split(None, 2)
    if not words:
        return None
    info = words[2].strip() if len(words) > 2 else "" if len(words) < 2 or _is_hash(words[1]) else words[1]
    return [words[0], "true" if line.startswith("*") else "false", info]


def _branch(t: Text, verbose: bool) -> Told:
    found = [row for line in t.bare if line and (row := _branch_row(line))]
    current = next((r[0] for r in found if r[1] == "true"), "")
    rows = found
    if len(found) > BRANCH_LIMIT:
        prefix = lambda r: r[0].split("/")[0]
        rows = [r for r in found if "/" not in r[0]]
        for name, inside in groupby(sorted((r for r in found if "/" in r[0]), key=prefix), key=prefix):
            members = list(inside)
            here = next((r[0] for r in members if r[1] == "true"), None)
            rows.append([f"{name}/", "false", f"{len(members)} branches" + (f", current: {here}" if here else "")])
    return plural(len(found), "branch", "es") + (f", current: {current}" if current else ""), ["branch", "current", "info"], rows


def _branch_score(t: Text) -> float:
    return 0.85 * (any(x.startswith("*") for x in t.bare) and sum(map(_is_branch, t.full)) >= 2)


# stash
def _stashed(line: str) -> list[str] | None:
    """Index, branch and message of 'stash@{0}: WIP on branch: message'."""
    name, _, rest = line.partition(": ")
    where, _, said = rest.strip().partition(": ")
    index, words = name.removeprefix("stash@{").removesuffix("}"), where.split()
    known = name == f"stash@{{{index}}}" and index.isdecimal() and words[:-1] in (["WIP", "on"], ["On"])
    return [index, words[-1], said.strip()] if known and said.strip() else None


def _stash(t: Text, verbose: bool) -> Told:
    rows = t.each(_stashed, bare=True)
    n = len(rows)
    if n > STASH_LIMIT:
        rows = [*rows[:STASH_HEAD], [f"... ({n - STASH_HEAD - STASH_TAIL} more)", "", ""], *rows[-STASH_TAIL:]]
    return plural(n, "stash", "es") if n else "No stashes", ["index", "branch", "message"], rows


def _many(read, enough: int):
    return lambda t: 0.9 if (n := len(t.each(read))) >= enough else 0.6 if n else 0.0


GIT_DIFF = Parser("git-diff", ("git-diff", "git"), _diff_score, _diff)
GIT_STATUS = Parser("git-status", ("git-status",), _status_score, _status)
GIT_LOG = Parser("git-log", ("git-log",), _log_score, _log)
GIT_SHOW = Parser("git-show", ("git-show",), _show_score, _show)
GIT_BLAME = Parser("git-blame", ("git-blame",), _many(_blamed, 3), _blame)
GIT_BRANCH = Parser("git-branch", ("git-branch",), _branch_score, _branch)
GIT_STASH = Parser("git-stash", ("git-stash",), _many(_stashed, 2), _stash)
