"""Secrets in texts: fixed patterns, and values in credential contexts weighed by the guesses that would find them.

The patterns are assign, access and hex; their spans stand as they are. Besides, every value that follows a
credential word is segmented at least cost into common words, dates, repeats, runs of the alphabet, keyboard
walks and brute-force spans. Words cost their rank: that of words people choose first, or that among the words of
all scanned documents by the number of documents, whichever is less. A value that would take 10 ** LEAST_LOG10 guesses or more adds a span of kind guess.

Defined results: a null text is an empty one, with no spans; each row gives one row, repeated or not; null ids
pass through. Offsets are code points, ends exclusive. Neither texts nor values are cut: blocks that are said again
are found by Lyndon words, so that a very long value takes little more than linear time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import map_rows

KINDS = ("assign", "access", "hex", "guess")
LEAST_LOG10 = 8.0
#: Costs of values up to this length are remembered.
SHORT = 256
#: Words ranked, at most, of so many letters; in so many documents, at least.
WORDS, LONGEST, LEAST_DOCUMENTS = 50_000, 20, 3

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy, so the same spans as + and a check of the length
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential, with what may stand between them and the value.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?key|bearer)["']?"""
    r"""(?:\x20*(?::=|=>|[:=])|\x20+is)\x20*["'`]?([^\s"'`<>,;()\[\]{}]{6,})""",
    re.I | re.A,
)
#: One of these letters pairs is in every context word, which a plain search rules out faster than the pattern.
HINTS = re.compile(r"pass|pwd|secret|token|credential|key|bearer", re.I | re.A)

#: Words that people choose first, most frequent first; a word's rank is its number of guesses.
COMMON = (
    "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou sunshine princess football "
    "baseball shadow superman michael batman trustno1 hello freedom whatever secret changeme default guest root test user "
    "example sample dummy placeholder your my the pass word key token api none null true false undefined xxx foo bar baz "
    "access private public server client admin1 love summer winter spring autumn monday friday january december money "
    "computer internet google apple amazon microsoft github docker python java node spark data base database system"
).split()
WORD = re.compile(rf"(?<!\w)[^\W\d_]{{3,{LONGEST}}}(?!\w)")
RANK = {w: n for n, w in reversed(list(enumerate(COMMON, 1)))}
LEET = str.maketrans("013457@$!", "oleastasi")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _spans(value: str, ranks: dict[str, int] = RANK) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 of guesses) of every pattern in the value."""
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if rank := ranks.get(low[i:j]) or ranks.get(plain[i:j]):
                cost = log10(rank + 1)
                cost += 0.5 * (value[i:j] != low[i:j]) + 0.5 * (low[i:j] != plain[i:j])
                yield i, j, cost
        if m := DATE.match(value, i):
            yield i, m.end(), log10(365 * 120) if m.end() - i > 4 else log10(120)
    for step, cost in (("repeat", 0.0), ("run", 0.7), ("walk", 1.3)):
        i = 0
        while i < n - 2:
            j = i + 1
            if step == "repeat":
                while j < n and low[j] == low[i]:
                    j += 1
            elif step == "run":
                way = ord(low[j]) - ord(low[i])
                while abs(way) == 1 and j < n and ord(low[j]) - ord(low[j - 1]) == way and low[j].isalnum() == low[i].isalnum():
                    j += 1
            else:
                while j < n and _near(low[j - 1], low[j]):
                    j += 1
            if j - i >= 3:
                yield i, j, cost + log10(_alphabet(value[i]) * (j - i))
            i = max(i + 1, j - 1) if j - i >= 3 else i + 1
    for i, j, size in _repetitions(value):
        times = (j - i) // size
        yield i, i + times * size, size * log10(26) + log10(times)


def _repetitions(value: str) -> list[tuple[int, int, int]]:
    """(start, end, size) of every longest stretch that says a block of size two or more at least twice.

    Each such stretch holds a Lyndon word of that size, for the order of characters or its reverse, that is the longest
    one from where it starts; there are at most as many stretches as characters. Common prefixes are told by hashes.
    """
    n, mod, base = len(value), (1 << 61) - 1, 0x1F3D5B79A2C4E68
    sums, powers = [0] * (n + 1), [1] * (n + 1)
    for i, c in enumerate(value):
        sums[i + 1], powers[i + 1] = (sums[i] * base + ord(c) + 1) % mod, powers[i] * base % mod

    def same(i: int, j: int, k: int) -> bool:
        return (sums[i + k] - sums[i] * powers[k] - sums[j + k] + sums[j] * powers[k]) % mod == 0

    def length(fits, most: int) -> int:
        """The greatest k up to most for which fits(k), which holds for all smaller ones."""
        if most <= 0 or not fits(1):
            return 0
        low = 1
        while low < most and fits(min(2 * low, most)):
            low = min(2 * low, most)
        high = min(2 * low, most + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    def ahead(i: int, j: int) -> int:
        return length(lambda k: same(i, j, k), n - max(i, j)) if max(i, j) < n and value[i] == value[j] else 0

    def back(i: int, j: int) -> int:
        return length(lambda k: same(i - k, j - k, k), min(i, j)) if min(i, j) and value[i - 1] == value[j - 1] else 0

    found = set()
    for sign in (1, -1):
        ends = [n] * (n + 1)  # of the longest Lyndon word from each place
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                k = ahead(i, j)
                if j + k < n and sign * (ord(value[i + k]) - ord(value[j + k])) < 0:
                    j = ends[j]
                else:
                    break
            ends[i] = j
            if (size := j - i) > 1 and j <= n:
                start, end = i - back(i, j), j + ahead(i, j)
                if end - start >= 2 * size:
                    found.add((start, end, size))
    return sorted(found)


class Guesses:
    """log10 of the guesses that find a value, with words by rank."""

    def __init__(self, ranks: dict[str, int] = RANK):
        self.ranks, self._remembered = ranks, lru_cache(maxsize=50_000)(self._least)

    def __call__(self, value: str) -> float:
        return self._remembered(value) if len(value) <= SHORT else self._least(value)

    def _least(self, value: str) -> float:
        """Least cost over all segmentations; each further segment costs a factor of two for being combined."""
        ends: dict[int, list[tuple[int, float]]] = {}
        for i, j, cost in _spans(value, self.ranks):
            ends.setdefault(j, []).append((i, cost))
        best = [0.0] * (len(value) + 1)
        for j, c in enumerate(value, 1):
            best[j] = best[j - 1] + log10(_alphabet(c))
            for i, cost in ends.get(j, ()):
                best[j] = min(best[j], best[i] + cost + (log10(2) if i else 0))
        return best[-1]


guesses_log10 = Guesses()


def secrets_in(text: str | None, guesses: Guesses = guesses_log10) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, log10 of guesses) by start, then kind as listed; hints and patterns run over the whole text."""
    text = text or ""
    out = [("hex", m.start(), m.end(), 0.0) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), 0.0) for m in ACCESS.finditer(text)]
    if HINTS.search(text):
        out += [("assign", m.start(), m.end(), guesses(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        out += [("guess", m.start(1), m.end(1), cost) for m in CONTEXT.finditer(text) if (cost := guesses(m[1])) >= LEAST_LOG10]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a batch, with the number of its texts that have them."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column("text"):
            counts.update(set(WORD.findall((text.as_py() or "").lower())))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def word_ranks(plain: DataFrame) -> dict[str, int]:
    """The rank of every word that is common or among the WORDS most frequent ones of all texts."""
    counts = map_rows(plain.select("text"), _word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "word").limit(WORDS).select("word").toArrow()
    return RANK | {w: min(k, RANK.get(w, k)) for k, w in enumerate(top.column("word").to_pylist(), 1)}


def _scan(ranks: dict[str, int]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses_log10", pa.float64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = Guesses(ranks)
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "guesses_log10"), x, strict=True)) for x in secrets_in(t.as_py(), guesses)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    return rows


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found (array of kind, start, end, guesses_log10) for each row of docs, which is read twice."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(plain, _scan(word_ranks(plain)), "doc_id long, found array<struct<kind:string,start:long,end:long,guesses_log10:double>>")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "guess")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
