"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

Native: only DataFrame and SQL functions. Texts are equal when identical after no change; null counts as empty.
Of equal texts in a batch the row with the largest doc_id stays (null ids are smaller than any id, and a group
of null ids only keeps null). A text that the index already holds is a repeat of the row indexed then.
Repeated rows of one doc_id share its fate; an empty batch leaves the index as it is.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.shared import ROWS_A_FILE, hot_split_join, shared_dir, written

INDEX_COLUMNS = {"digest": "binary", "keep_id": "bigint", "group_size": "bigint", "batch": "string"}
#: Runs from which an append merges all of them into one.
MOST_RUNS = 16
#: Makes scans of a run tell its order where each bucket is one file, so that a merge join needs no sort of it.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """One row for each distinct text seen: digest, the doc_id that stays, the number of rows in its batch, its batch.

    The index is a folder of runs, which outlives the session. A run is a table in buckets, one file a bucket, sorted
    by digest; each has buckets for its own size, so the index grows with its data. New texts make a new run, and
    many runs are merged into one. What counts is the newest list of runs, which is published by a rename once its
    runs are complete: an append that fails leaves the index as it was, and is repeated under the same batch name
    without being taken for a copy of itself. There is one writer at a time; of two, the later rename fails.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.newest = 0  # about how many texts the last batch added

    def _fs(self):
        return self._hadoop.Path(self.location).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, list[dict]]:
        """The number of the newest list, and the runs it names; (0, []) for a new index."""
        fs, folder = self._fs(), self._hadoop.Path(f"{self.location}/lists")
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
        if not numbers:
            return 0, []
        stream = fs.open(self._hadoop.Path(f"{self.location}/lists/{max(numbers)}"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, number: int, runs: list[dict]) -> None:
        fs = self._fs()
        draft, final = self._hadoop.Path(f"{self.location}/lists/.{uuid.uuid4().hex}"), self._hadoop.Path(f"{self.location}/lists/{number}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(runs).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise RuntimeError(f"another writer has changed the index at {self.location}")

    def _table(self, run: dict) -> DataFrame:
        """A run as a table that knows its buckets. The catalogue holds it only while the plan is made."""
        name = f"digest_run_{uuid.uuid4().hex}"
        columns = ", ".join(f"{c} {kind}" for c, kind in INDEX_COLUMNS.items())
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {run['buckets']} BUCKETS LOCATION '{self.location}/{run['name']}'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    @contextmanager
    def _in_order(self):
        before = self.spark.conf.get(_ORDERED)
        self.spark.conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_ORDERED, before)

    def rows(self) -> DataFrame:
        _, runs = self._state()
        out = self.spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in INDEX_COLUMNS.items()])
        for run in runs:
            out = out.unionByName(self._table(run))
        return out

    def _write_run(self, rows: DataFrame, n: int) -> dict:
        """Dealt by the buckets' own hash, so that each bucket is one sorted file."""
        run = {"name": f"run-{uuid.uuid4().hex}", "buckets": max(1, -(-n // ROWS_A_FILE))}
        dealt = rows.select(*INDEX_COLUMNS).repartition(run["buckets"], "digest").coalesce(run["buckets"])
        name = f"digest_run_{uuid.uuid4().hex}"
        dealt.write.bucketBy(run["buckets"], "digest").sortBy("digest").option("path", f"{self.location}/{run['name']}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return run

    def compact(self) -> None:
        """All runs as one; the folders of the old ones stay until remove_old, for readers that hold them."""
        number, runs = self._state()
        if len(runs) > 1:
            rows = self.rows()
            merged = self._write_run(rows, sum(r["rows"] for r in runs)) | {"rows": sum(r["rows"] for r in runs), "batches": [b for r in runs for b in r["batches"]]}
            self._publish(number + 1, [merged])

    def remove_old(self) -> None:
        """Deletes the folders of runs that the newest list does not name."""
        _, runs = self._state()
        fs, named = self._fs(), {r["name"] for r in runs}
        for status in fs.listStatus(self._hadoop.Path(self.location)):
            if status.getPath().getName().startswith("run-") and status.getPath().getName() not in named:
                fs.delete(status.getPath(), True)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Appends the new texts of docs; returns doc_id, digest, keep_id, group_size, seen_before for each row.

        batch names docs: added again under the same name, as after a failure, they get the same rows as the first time
        and are appended once.
        """
        number, runs = self._state()
        batch = batch or uuid.uuid4().hex
        folder = shared_dir(self.spark)
        digests = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest")), folder, "digests")
        self.newest = rows = digests.count()
        groups = written(digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), folder, "groups", rows)
        fresh, repeats = groups, None
        with self._in_order():
            for run in runs:
                known = self._table(run).filter(F.col("batch") != batch).hint("merge")
                here = groups.join(known.select("digest", F.col("keep_id").alias("known_keep"), F.col("group_size").alias("known_size")), "digest")
                repeats = here if repeats is None else repeats.unionByName(here)
                fresh = fresh.join(known.select("digest"), "digest", "left_anti")
            fresh = fresh.withColumn("batch", F.lit(batch))
            if not any(batch in run["batches"] for run in runs):
                run = self._write_run(fresh, rows)
                fresh = self._table(run)
                self.newest = fresh.count()
                if self.newest:
                    runs = [*runs, run | {"rows": self.newest, "batches": [batch]}]
                    self._publish(number + 1, runs)
            found = fresh.select("digest", "keep_id", "group_size", F.col("group_size").alias("batch_size"), F.lit(False).alias("seen_before"))
            if repeats is not None:
                found = found.unionByName(repeats.select("digest", F.col("known_keep").alias("keep_id"), (F.col("group_size") + F.col("known_size")).alias("group_size"), F.col("group_size").alias("batch_size"), F.lit(True).alias("seen_before")))
                found = written(found, folder, "found", rows)
        if len(runs) > MOST_RUNS:
            self.compact()
        return hot_split_join(digests, found, "digest", "batch_size").drop("batch_size")


def new_index(spark: SparkSession) -> DigestIndex:
    """An empty index in a folder of its own below the shared one."""
    return DigestIndex(spark, f"{shared_dir(spark)}/index")


def drop_repeats(index: DigestIndex, docs: DataFrame, batch: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text is new to the index; one row for each text.

    Rows that tie (the same doc_id and text, or null ids) are reduced to one by digest. Such groups alone are
    shuffled with their texts; the rest is filtered where it stands by a join on (doc_id, digest).
    """
    found = index.add(docs, batch=batch)
    ours = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & ~F.col("seen_before")
    stays = found.filter(ours).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.count(F.lit(1)).alias("__ties"))
    stays = written(stays, shared_dir(index.spark), "stays", index.newest)
    tagged = docs.withColumn("__text_digest", text_digest(F.col("text")))
    matched = tagged.join(stays.hint("shuffle_hash"), (F.col("__text_digest") == F.col("__digest")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")))
    single = matched.filter("__ties = 1").select(docs.columns)
    tied = matched.filter("__ties > 1").dropDuplicates(["__digest"]).select(docs.columns)
    return single.unionByName(tied)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return new_index(spark).add(docs, batch="documents").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
