"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matches.

Words are runs of other than ASCII white space with A-Z lower-cased. An item and a document that share a seed of
SEED words (all of an item with fewer) are tiled: windows of the item are looked up by rolling hash among the
document's, matches are extended, and the longest that overlap no tile are marked until none of SEED words is
left. Tiles may lie in any order, so reordered passages count. An item's coverage is the share of its words in
tiles; a document is contaminated if some item's coverage reaches COVERAGE.

The benchmark is the query set: it is read in blocks of at most BLOCK_WORDS words, each sent to all tasks, and every
document is compared with every block. Defined results: null, empty or blank texts and items match nothing; null
ids pass through; each row gives one row, repeated or not; of items of equal coverage the one with the least item_id
is told, one without an id last, then the one with most words in tiles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestrata.llm.shared import map_rows, shared_dir, written

SEED, COVERAGE = 5, 0.75
#: Words of benchmark items that one pass over the documents compares with, about 100 MB in a worker.
BLOCK_WORDS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width ids, by Horner's rule over the whole array at once."""
    if len(ids) < width:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        out = out * _BASE + _mixed(ids[k : len(ids) - width + 1 + k].astype(np.uint64) + np.uint64(1))
    return out


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy tiles, longest first; none shorter than least."""
    windows = defaultdict(list)
    for j, h in enumerate(rolling(doc, least).tolist()):
        windows[h].append(j)
    starts = [(i, j) for i, h in enumerate(rolling(item, least).tolist()) for j in windows.get(h, ())]
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    found = []
    while starts:
        runs = []
        reached = {}  # the end of the last run on each diagonal: starts inside it extend to the same end
        for i, j in starts:
            if reached.get(j - i, -1) > i:
                continue
            n = 0
            while i + n < len(item) and j + n < len(doc) and free_item[i + n] and free_doc[j + n] and item[i + n] == doc[j + n]:
                n += 1
            if n >= least:
                runs.append((n, i, j))
                reached[j - i] = i + n
        if not runs:
            break
        longest = max(runs)[0]
        for n, i, j in runs:
            if n == longest and free_item[i : i + n].all() and free_doc[j : j + n].all():
                free_item[i : i + n] = free_doc[j : j + n] = False
                found.append((i, j, n))
        starts = [(i, j) for i, j in starts if free_item[i] and free_doc[j]]
    return found


class Items:
    """A block of benchmark items: their words as ids, and the items that have each seed."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        seeds = defaultdict(set)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64)
            least = min(SEED, len(ids))
            for h in rolling(ids, least).tolist():
                seeds[least, h].add(len(self.items))
            self.items.append((item_id, ids, least))
        self.seeds = dict(seeds)
        self.hashes = {least: np.sort(np.array([h for n, h in seeds if n == least], np.uint64)) for least in {n for n, _ in seeds}}

    def covered(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item_id, coverage, words in tiles) for each item that shares a seed with the text."""
        get = self.vocabulary.get
        doc = np.array([get(w, -1) for w in words_of(text)], np.int64)
        candidates = set()
        for least, known in self.hashes.items():
            own = rolling(doc, least)
            hits = own[known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own] if len(own) else own
            for h in np.unique(hits).tolist():
                candidates |= self.seeds[least, h]
        out = []
        if candidates:
            doc = np.where(doc < 0, -2, doc)
            for k in sorted(candidates):
                item_id, ids, least = self.items[k]
                marked = sum(n for _, _, n in tiles(ids, doc, least))
                if marked:
                    out.append((item_id, marked / len(ids), marked))
        return out


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", ids_only: bool = False) -> Iterator[list]:
    """The distinct items (id, text), in lists of about BLOCK_WORDS words, one on the driver at a time; ids_only: the lists' parts."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter(F.trim("text") != "").distinct()
    items = items.withColumn("n", F.size(F.split("text", r"\s+")).cast("long")).withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(1024)))
    sizes = items.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # over 1024 rows at most
    blocks: dict[int, list[int]] = defaultdict(list)
    for r in sizes.withColumn("block", (F.coalesce(before, F.lit(0)) / BLOCK_WORDS).cast("int")).collect():
        blocks[r["block"]].append(r["part"])
    for parts in blocks.values():
        yield parts if ids_only else [(r["item_id"], r["text"]) for r in items.filter(F.col("part").isin(parts)).select("item_id", "text").orderBy("item_id", "text").collect()]


def _coverages(held: Items):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, coverage, n_items, tiled = [], [], [], []
            for text in batch.column("text"):
                found = held.covered(text.as_py())
                top = min(found, key=lambda x: (-x[1], x[0] is None, x[0] or 0, -x[2]), default=(None, 0.0, 0))
                best.append(top[0])
                coverage.append(top[1])
                n_items.append(sum(x[1] >= COVERAGE for x in found))
                tiled.append(top[2])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.int64()), pa.array(coverage, pa.float64()), pa.array(n_items, pa.int64()), pa.array(tiled, pa.int64())], ["doc_id", "item_id", "coverage", "n_items", "tiled_words"])

    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id (of the best covered item, else null), coverage, n_items (at or over COVERAGE), tiled_words,
    contaminated, for each row of docs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = "doc_id long, item_id long, coverage double, n_items long, tiled_words long"
    blocks = list(benchmark_blocks(benchmark, ids_only=True))
    if len(blocks) <= 1:
        found = map_rows(plain, _coverages(Items(next(benchmark_blocks(benchmark), []))), out)
    else:  # the best of each document over all blocks, by a row number that repeated rows do not share
        folder = shared_dir(docs.sparkSession)
        plain = written(plain.withColumn("__row", F.monotonically_increasing_id()), folder, "rows")
        found = None
        for k, items in enumerate(benchmark_blocks(benchmark)):
            one = written(map_rows(plain.select(F.col("__row").alias("doc_id"), "text"), _coverages(Items(items)), out), folder, f"block{k}")
            found = one if found is None else found.union(one)
        best = F.max_by(F.struct("item_id", "coverage", "tiled_words"), F.struct("coverage", -F.col("item_id"), "tiled_words")).alias("best")
        found = found.groupBy(F.col("doc_id").alias("__row")).agg(best, F.sum("n_items").alias("n_items"))
        found = found.join(plain.select("__row", "doc_id"), "__row").select("doc_id", "best.item_id", "best.coverage", "n_items", "best.tiled_words")
    return found.withColumn("contaminated", F.col("coverage") >= COVERAGE)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose text covers no item to COVERAGE; filtered where they stand."""
    for items in benchmark_blocks(benchmark):

        def rows(batches: Iterator[pa.RecordBatch], held: Items = Items(items)) -> Iterator[pa.RecordBatch]:  # noqa: B008
            for batch in batches:
                yield batch.filter(pa.array([all(c < COVERAGE for _, c, _ in held.covered(t.as_py())) for t in batch.column("text")], pa.bool_()))

        docs = map_rows(docs, rows, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
