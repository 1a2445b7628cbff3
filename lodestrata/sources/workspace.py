"""Tables cut from their lineage, in the folder that a cluster's executors share, and Arrow batches of bounded size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a cluster
    it is an error, as executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodestrata/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def remove_shared(spark: SparkSession) -> None:
    """Deletes all that this application wrote below spark.checkpoint.dir; tables read from there are gone after it."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/lodestrata/{spark.sparkContext.applicationId}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Narrow rows that one file of an intermediate table holds, about.
ROWS_A_FILE = 200_000


def written(df: DataFrame, folder: str, name: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet below folder and read again: survives lost executors, unlike a local checkpoint.

    rows: about how many narrow rows there are, for as many files as they need, not one for each shuffle partition.
    These files are smaller than the shares into which adaptive execution splits a skewed partition, so splits stay.
    """
    path = f"{folder}/{name}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its source has fewer files than there are cores, so few and small ones; else as it is.

    For work that costs much more than a shuffle of its rows, such as parsing texts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


#: Arrow batches hold at most this many rows, and about this many bytes (a longer row makes a batch of its own), so
#: that a batch of long texts fits a worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of bounded rows and bytes. The bounds are the session's, which knows no others: they are
    lowered where they are higher, for all that the session plans later."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(rows, schema)
