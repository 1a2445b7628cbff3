"""Streams: a graph kept up to date as files arrive, and usage facts rolled up as calls come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.plans.index import reindex_changed
from lodestrata.sources.store import Store

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, interval: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Re-indexes when new or changed source files appear below root. A file stream does not see deletions; each
    batch compares the whole listing with the stored hashes, so they are noticed with the next change."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).load(root).select("path", "modificationTime")

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            reindex_changed(batch.sparkSession, root, store)

    writer = files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def usage_stream(calls: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Tokens by tool and window over a stream of calls (ts, tool, content_tokens, baseline_tokens); late rows within
    the watermark still count."""
    window = F.window("ts", every)
    sums = [F.count(F.lit(1)).alias("queries"), F.sum("content_tokens").alias("content_tokens"), F.sum("baseline_tokens").alias("baseline_tokens")]
    return calls.withWatermark("ts", late).groupBy(window, "tool").agg(*sums).select(F.col("window.start").alias("start"), "tool", "queries", "content_tokens", "baseline_tokens")


def event_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same over events (ts, event_type, value); beyond the tools' own operators."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
