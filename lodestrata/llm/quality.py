"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled texts of quality 1 outside the held-out fold; the unlabelled are a sample of all
documents, whose labels are not read. The class prior is estimated from how rarely, relative to the positives,
any region of a first model's scores occurs among the unlabelled. A linear model over standardised surface
features, their squares and hashed character trigrams minimises  prior * R+(P) + max(0, R-(U) - prior * R-(P)).

Both samples are bounded by SAMPLE rows. Defined results: a null text is an empty one, and has a score too; each
row gives one row, repeated or not; without positives or documents all scores are 1. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import map_rows, shared_dir, written
from lodestrata.llm.training import fold_of, labelled_ids, sampled

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Positive rows, and unlabelled rows, that the model is fitted on, at most.
SAMPLE = 10_000
STEPS, RATE, RIDGE = 400, 0.05, 1e-3

_KIND = np.zeros(0x3000, np.uint8)  # 1 lower-case, 2 upper-case, 3 digit, 4 white space, 5 sentence marks, 6 any other
_KIND[:] = 6
for _c in range(0x3000):
    if chr(_c).isalpha():
        _KIND[_c] = 2 if chr(_c).isupper() else 1
    elif chr(_c).isdigit():
        _KIND[_c] = 3
    elif chr(_c).isspace():
        _KIND[_c] = 4
    elif chr(_c) in ".,;:'\"-()?":
        _KIND[_c] = 5
#: Surface features, and buckets that trigrams are hashed into.
SURFACE, GRAM_BITS = 11, 9
FEATURES = SURFACE + (1 << GRAM_BITS)
#: Weight of the shares beside the standardised surface features, chosen on a fold of the rows that may be learned from.
GRAM_SCALE = 12.0
#: Characters hashed at a time, so that a long text takes no more memory for it.
PIECE = 1 << 20


def gram_shares(words: list[str]) -> np.ndarray:
    """Square roots of the buckets' shares of all character trigrams of the words, each word between blanks."""
    text = f" {' '.join(words)} "
    counts = np.zeros(1 << GRAM_BITS, np.int64)
    for start in range(0, len(text) - 2, PIECE):
        codes = np.frombuffer(text[start : start + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        counts += np.bincount(((mixed ^ (mixed >> 15)) * np.uint32(0x2C1B3C6D)) >> (32 - GRAM_BITS), minlength=1 << GRAM_BITS)
    return np.sqrt(counts / counts.sum())


def features(text: str | None) -> np.ndarray:
    """Surface shares of a text, then its trigrams; all zero for an empty one."""
    text = text or ""
    words = text.split()
    if not words:
        return np.zeros(FEATURES, np.float32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.bincount(_KIND[np.minimum(codes, 0x2FFF)], minlength=7)
    n, letters = len(text), max(1, kinds[1] + kinds[2])
    lines = [x for x in text.split("\n") if x]
    low = text.lower().split()
    twice = sum(a == b for a, b in zip(low, low[1:]))
    kinds_of_words = len(set(low))
    surface = [
        kinds[6] / n, kinds[2] / letters, kinds[3] / n, kinds[5] / n, text.count("!") / len(words),
        twice / len(words), kinds_of_words / len(words), kinds_of_words / len(words) ** 0.75,
        np.log1p(len(words)), n / len(words) / 10, 1 - len(set(lines)) / max(1, len(lines)),
    ]
    return np.concatenate([surface, gram_shares(low)]).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([features(t.as_py()) for t in column]) if len(column) else np.zeros((0, FEATURES), np.float32)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(x, pa.binary())], ["positive", "x"])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_expand(x, self.mean, self.scale) @ self.weights)


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.clip((x - mean) / scale, -4, 4)  # else very short texts decide by their squares
    return np.concatenate([np.ones((len(x), 1)), x, np.square(x[:, :SURFACE]) / 4], axis=1, dtype=np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def slope(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The second term of the risk with logistic loss, R-(U) - prior * R-(P), and the direction to go down: the whole
    risk's gradient, or, while that term is negative, the one that drives it up."""
    fp, fu = _sigmoid(p @ w), _sigmoid(u @ w)
    loss_minus = lambda f: -np.log(np.maximum(1 - f, 1e-12)).mean()
    rest = float(loss_minus(fu) - prior * loss_minus(fp))
    g_rest = u.T @ fu / len(u) - prior * (p.T @ fp) / len(p)
    return rest, prior * (p.T @ (fp - 1)) / len(p) + g_rest if rest >= 0 else -g_rest


def _minimise(p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Adam on the non-negative risk with a ridge."""
    w, m, v = np.zeros(p.shape[1], np.float32), 0.0, 0.0
    for step in range(1, STEPS + 1):
        g = slope(p, u, prior, w)[1] + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The least ratio of U's to P's mass above any score, over scores that half of P exceeds.

    U holds prior * P plus others, so no region can hold less than prior times P's share of it.
    """
    cuts = np.quantile(p, np.linspace(0, 0.5, 26))
    ratios = [(u >= c).mean() / (p >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The prior comes from a model that tells P from U, on halves it was not fitted on."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0, dtype=np.float64), both.std(axis=0, dtype=np.float64) + 1e-6
    scale[SURFACE:] = 1 / GRAM_SCALE
    p, u = (_expand(x, mean, scale) for x in (positive, unlabelled))
    if len(p) >= 4 and len(u) >= 4:
        first = _minimise(p[::2], u[::2], 0.5)
        prior = estimated_prior(p[1::2] @ first, u[1::2] @ first)
    else:
        prior = 0.5
    return Model(mean, scale, _minimise(p, u, prior), prior)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs (doc_id, text), labels (doc_id, quality)."""
    folder = shared_dir(docs.sparkSession)
    positives = labelled_ids(labels, "quality", FOLDS, HELD_OUT).filter("label = 1").drop("label")
    trusted = sampled(docs, positives, sample).select(F.lit(True).alias("positive"), "text")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    web = sampled(docs, ids, sample).select(F.lit(False).alias("positive"), "text")
    x = written(map_rows(trusted.union(web), _vectors, "positive boolean, x binary"), folder, "sample").toArrow()
    rows = np.frombuffer(b"".join(x.column("x").to_pylist()), np.float32).reshape(-1, FEATURES)
    positive = np.array(x.column("positive").to_pylist(), bool)
    if not positive.any() or positive.all():
        return None
    return fit(rows[positive], rows[~positive])


def score_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.ones(len(batch)) if model is None else model.score(_matrix(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, "doc_id long, score double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
