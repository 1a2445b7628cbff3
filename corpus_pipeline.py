"""A corpus pipeline of five stages; each takes what the one before kept.

Each function takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage's result is
written as Parquet and read again as the next one's docs. Empty documents pass all filters: they are not toxic, one
of them stays after exact deduplication, they resemble and cover nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, decontaminate, exact_dedup, near_dedup, toxicity
from lodestrata.llm.shared import shared_dir, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learned from the labelled rows of docs outside the held-out fold; rejected documents go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_repeats(exact_dedup.new_index(spark), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: Learned and hashed stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
