"""Labelled rows for the classifiers: a bounded, deterministic sample that never holds a held-out row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sampled(docs: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """docs (doc_id, text, ...) joined to at most limit rows of ids (doc_id, label), least hashes first.

    The limit bounds what is broadcast, and each task passes on as many rows at most, so nothing is shuffled.
    """
    few = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).dropDuplicates(["doc_id"])
    return docs.join(F.broadcast(few), "doc_id")


def labelled_ids(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, label 0 or 1) of the rows that may be learned from; rows of one doc_id that disagree count as 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(fold_of(F.col("doc_id"), folds) != held_out)
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))
