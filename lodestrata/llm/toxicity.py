"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded text.

Folding undoes compatibility forms, accents and look-alike letters of other scripts, lower-cases, drops invisible
characters, and reads digits as the letters they stand in for. Matches are whole words, which underscores end. A match inside an
exception phrase does not count. The sum of weights is taken raw and per word, and a logistic curve over both
gives the score.

The lexicon, the exceptions and the curve are learned from at most SAMPLE labelled rows outside the held-out
fold; near-copies within the sample count once. Defined results: a null or empty text has no matches and the
score of a text without any; each row gives one row, repeated or not; without labels of both kinds all scores
are 0. Texts are never cut.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import map_rows, shared_dir, written
from lodestrata.llm.training import fold_of, labelled_ids, sampled

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Labelled rows that the lexicon and the curve are learned from, at most; words of the lexicon, at most.
SAMPLE, LEXICON = 20_000, 5_000
#: A word enters the lexicon with so many toxic texts (and this share of them), such a log odds ratio and such a
#: z-score, at least.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, LEAST_Z = 4, 0.005, 2.0, 3.0
#: Words that are harmless in company; learned exceptions are added.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish")

#: Look-alike letters of Cyrillic and Greek, in pairs with the Latin letter each is read as.
LOOKALIKES = "аa вb сc еe нh іi јj кk мm оo рp ѕs тt уy хx ԁd ԛq ԝw αa βb εe ηn ιi κk νv οo ρp τt υu χx γy ωw"
DIGITS = "0o 1i 3e 4a 5s 7t 8b 9g @a $s li"  # l and i fall together, as 1 is read as either
INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)))
#: Combining marks of Latin, Greek and Cyrillic; those of other scripts can be letters there, and stay.
MARKS = [*range(0x300, 0x370), *range(0x1AB0, 0x1B00), *range(0x1DC0, 0x1E00), *range(0x20D0, 0x2100), *range(0xFE20, 0xFE30)]
_FOLD = {ord(x[0]): x[1].replace("l", "i") for x in f"{LOOKALIKES} {DIGITS}".split()} | dict.fromkeys([*map(ord, INVISIBLE), *MARKS])
_ASCII_FOLD = {k: v for k, v in _FOLD.items() if k < 128}
_WORD = re.compile(r"[^\W_]+")


def folded(text: str | None) -> list[str]:
    """The folded words of a text."""
    text = text or ""
    if text.isascii():
        return _WORD.findall(text.lower().translate(_ASCII_FOLD))
    bare = unicodedata.normalize("NFKD", text).lower().translate(_FOLD)
    return _WORD.findall(unicodedata.normalize("NFC", bare))


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] | None = None  # bias, raw, per word

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(f" {word} ", (len(word) + 2, weight))
        for phrase in self.exceptions:
            found.add_word(f" {' '.join(folded(phrase))} ", (len(" ".join(folded(phrase))) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, raw: float, words: int) -> float:
        if self.curve is None:
            return 0.0
        z = self.curve[0] + self.curve[1] * math.log1p(raw) + self.curve[2] * math.log1p(100 * raw / max(words, 1))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def weigh(words: list[str], automaton: ahocorasick.Automaton) -> float:
    """The sum of weights of matches that lie in no exception phrase."""
    if not len(automaton) or not words:
        return 0.0
    hits, spared = [], []
    for end, (size, weight) in automaton.iter(f" {' '.join(words)} "):
        (spared if weight is None else hits).append((end - size, end, weight))
    if not spared:
        return sum(w for _, _, w in hits)
    # by starts, with the furthest end of the exceptions that start no later
    hits.sort(key=lambda x: x[0])
    spared.sort(key=lambda x: x[0])
    total, at, furthest = 0.0, 0, -1
    for start, end, weight in hits:
        while at < len(spared) and spared[at][0] <= start:
            furthest, at = max(furthest, spared[at][1]), at + 1
        total += weight * (furthest < end)
    return total


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and pairs of neighbours of each text, with a sketch that near-copies mostly share."""
    for batch in batches:
        words, pairs, sketches = [], [], []
        for text in batch.column("text"):
            found = folded(text.as_py())
            kinds = set(found)
            words.append(list(kinds))
            pairs.append(list({f"{a} {b}" for a, b in zip(found, found[1:])}))
            least = sorted(xxhash.xxh3_64_intdigest(w) for w in kinds)[:3]
            sketches.append(xxhash.xxh3_64_intdigest(str(least)) >> 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sketches, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(pairs, pa.list_(pa.string()))], ["doc_id", "label", "sketch", "words", "pairs"])


def _raw_scores(lexicon: Lexicon):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            texts = [folded(t.as_py()) for t in batch.column("text")]
            raw = [weigh(words, automaton) for words in texts]
            score = [lexicon.score(r, len(words)) for r, words in zip(raw, texts, strict=True)]
            kept = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(raw, pa.float64()), pa.array(map(len, texts), pa.int64()), pa.array(score, pa.float64())], [*(c for c in batch.schema.names if c != "text"), "raw", "words", "score"])

    return rows


def _curve(label: np.ndarray, raw: np.ndarray, words: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(raw)), np.log1p(raw), np.log1p(100 * raw / np.maximum(words, 1))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3), x.T @ (label - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> Lexicon:
    """docs (doc_id, text), labels (doc_id, toxic). What comes to the driver is bounded by sample and size."""
    folder = shared_dir(docs.sparkSession)
    rows = written(sampled(docs, labelled_ids(labels, "toxic", FOLDS, HELD_OUT), sample), folder, "sample")
    each = written(map_rows(rows.select("doc_id", "label", "text"), _sample_words, "doc_id long, label int, sketch long, words array<string>, pairs array<string>").withColumn("row", F.monotonically_increasing_id()), folder, "words")
    # only numbers of rows and sketches are shuffled; the numbers that stay, no more than the sample, go to the words
    stay = each.groupBy("label", "sketch").agg(F.min("row").alias("row")).select("row")
    each = each.join(F.broadcast(written(stay, folder, "stay", sample)), "row", "left_semi")
    n = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Lexicon()
    counts = each.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    smooth = lambda k, of: F.log((F.col(k) + 0.5) / (of - F.col(k) + 0.5))
    odds = counts.withColumn("odds", smooth("t", n[1]) - smooth("c", n[0])).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    best = odds.filter((F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * n[1])) & (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "word").limit(size).collect()
    weights = {r["word"]: r["odds"] for r in best}
    near = each.select("label", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    harmless = near.filter(f"t = 0 AND c >= {LEAST_TEXTS}").filter(F.split("pair", " ")[0].isin(list(weights)) | F.split("pair", " ")[1].isin(list(weights))) if weights else near.limit(0)
    lexicon = Lexicon(weights, EXCEPTIONS + tuple(r["pair"] for r in harmless.orderBy(F.desc("c"), "pair").limit(size).collect()))
    fits = map_rows(rows.select("label", "text"), _raw_scores(lexicon), "label int, raw double, words long, score double").select("label", "raw", "words").toArrow()
    lexicon.curve = _curve(*(fits.column(c).to_numpy().astype(float) for c in ("label", "raw", "words")))
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, raw (sum of weights), words, score for each row of docs."""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), _raw_scores(lexicon), "doc_id long, raw double, words long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below threshold; filtered where they stand."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            texts = [folded(t.as_py()) for t in batch.column("text")]
            yield batch.filter(pa.array([lexicon.score(weigh(words, automaton), len(words)) < threshold for words in texts], pa.bool_()))

    return map_rows(docs, rows, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
