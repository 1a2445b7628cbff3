"""Shell commands: chains, their primary command, and the hint that tells how to compact its output."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which commands are silent, which pass through, and which hint each prefix gives, first match first.
SILENT = (
    "cd ", "cd\t", "mkdir", "cp ", "cp\t", "mv ", "mv\t", "rm ", "rm\t", "export ", "source ", ". ", ".\t", "pushd", "popd", "set ", "set\t",
    "unset ", "unset\t", "alias", "ulimit", "git add", "git checkout", "git stash push", "git stash pop", "git stash drop",
)
PASS_THROUGH = ("bat", "batcat", "vim", "nvim", "nano", "less", "more", "ssh", "sudo")
SOURCE_ENDINGS = "py js ts tsx jsx rb go rs java cpp c h hpp cs swift kt scala sh bash zsh fish".split()
PREFIXES = (
    ("git diff", "git-diff"), ("git status", "git-status"), ("git log", "git-log"), ("git show", "git-show"), ("git blame", "git-blame"),
    ("git branch", "git-branch"), ("git stash list", "git-stash"),
    ("pytest", "pytest"), ("python -m pytest", "pytest"), ("python3 -m pytest", "pytest"), ("python -m unittest", "unittest"), ("python3 -m unittest", "unittest"),
    ("ruff check", "ruff"), ("ruff .", "ruff"), ("mypy", "mypy"), ("pyright", "pyright"),
    ("pip list", "pip-list"), ("pip freeze", "pip-freeze"), ("pip install", "pip"),
    ("jest", "jest"), ("npx jest", "jest"), ("yarn jest", "jest"), ("pnpm jest", "jest"), ("vitest", "vitest"), ("npx vitest", "vitest"), ("yarn vitest", "vitest"),
    ("mocha", "mocha"), ("npx mocha", "mocha"), ("eslint", "eslint"), ("npx eslint", "eslint"), ("tsc", "tsc"), ("npx tsc", "tsc"),
    ("webpack", "webpack"), ("npx webpack", "webpack"), ("vite build", "vite"), ("npx vite build", "vite"),
    ("npm install", "npm"), ("npm ci", "npm"), ("npm run build", "npm"), ("npm test", "npm"), ("npm run", "npm"),
    ("cargo test", "cargo-test"), ("cargo build", "cargo-build"), ("cargo check", "cargo-build"), ("cargo clippy", "cargo-clippy"),
    ("docker compose", "docker-compose"), ("docker-compose", "docker-compose"), ("docker build", "docker"), ("docker ps", "docker-ps"),
    ("docker images", "docker-images"), ("docker logs", "docker-logs"), ("kubectl", "kubectl"),
    ("grep -r", "grep"), ("grep -rn", "grep"), ("grep --include", "grep"), ("rg ", "rg"), ("ag ", "ag"), ("ls", "ls"), ("tree", "tree"), ("find ", "find"),
    ("gh pr", "gh"), ("gh issue", "gh"), ("gh run", "gh"), ("env", "env"), ("printenv", "env"),
)
_TOKEN = re.compile(r"""\"[^\"]*\"?|'[^']*'?|&&|;|[^;&"']+|&""")


def split_chain(command: str | None) -> list[str]:
    """Commands between && and ; outside quotes, stripped, none empty."""
    pieces = [""]
    for token in _TOKEN.findall(command or ""):
        if token in ("&&", ";"):
            pieces.append("")
        else:
            pieces[-1] += token
    return [piece for p in pieces if (piece := p.strip())]


def find_primary(commands: list[str]) -> str:
    """The last command that prints, else the last."""
    return next((c for c in reversed(commands) if not c.strip().startswith(SILENT)), commands[-1] if commands else "")


def _reads_source(words: list[str]) -> bool:
    return any(w.strip("\"'").rpartition(".")[2] in SOURCE_ENDINGS for w in words if "." in w)


def match_command(command: str | None) -> str | None:
    """The hint of a known command; none for pipes, redirections, pagers, and reading source files."""
    said = (command or "").strip()
    words = said.split()
    if not words or "|" in said or ">" in said or words[0] in PASS_THROUGH:
        return None
    if words[0] in ("cat", "head", "tail") and _reads_source(words[1:]):
        return None
    return next((hint for prefix, hint in PREFIXES if said == prefix or said.startswith((prefix + " ", prefix + "\t")) or (prefix.endswith(" ") and said.startswith(prefix))), None)


def command_hint(command: Column) -> Column:
    """match_command without Python: one pass over the ordered prefixes."""
    said = F.regexp_replace(F.coalesce(command, F.lit("")), r"^\s+|\s+$", "")
    base = F.regexp_extract(said, r"^(\S+)", 1)
    source = rf"""\s\S*\.(?:{"|".join(SOURCE_ENDINGS)})["']*(?:\s|$)"""
    hint = F.when(F.contains(said, F.lit("|")) | F.contains(said, F.lit(">")) | base.isin("", *PASS_THROUGH), F.lit(None).cast("string"))
    hint = hint.when(base.isin("cat", "head", "tail") & said.rlike(source), F.lit(None).cast("string"))
    for prefix, name in PREFIXES:
        hit = said.startswith(prefix) if prefix.endswith(" ") else (said == prefix) | said.startswith(prefix + " ") | said.startswith(prefix + "\t")
        hint = hint.when(hit, name)
    return hint


def wrapped_command(command: str, runner: str) -> str:
    """The command through runner, if its primary one has a hint."""
    if match_command(find_primary(split_chain(command))) is None:
        return command
    return f"{runner} '{command.replace(chr(39), chr(39) + chr(92) + chr(39) + chr(39))}'"
