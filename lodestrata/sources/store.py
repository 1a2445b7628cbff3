"""Graphs as Parquet tables: nodes, edges and file hashes of a project in one folder, written whole and read by scan.

A build is written to a new version folder, and becomes current with the one-row table that names it; readers of
the earlier version are not disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("nodes", "edges", "file_hashes")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "current"))

    def version(self) -> str | None:
        return self.spark.read.schema("version string").json(f"{self.path}/current").first()[0] if self.exists() else None

    def write(self, nodes: DataFrame, edges: DataFrame, file_hashes: DataFrame) -> None:
        version = uuid.uuid4().hex
        for name, df in zip(TABLES, (nodes, edges, file_hashes), strict=True):
            df.write.parquet(f"{self.path}/{version}/{name}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{self.path}/current")

    def table(self, name: str) -> DataFrame:
        if not self.exists():
            raise FileNotFoundError(f"no graph at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{self.version()}/{name}")

    def nodes(self) -> DataFrame:
        return self.table("nodes")

    def edges(self) -> DataFrame:
        return self.table("edges")

    def file_hashes(self) -> DataFrame:
        return self.table("file_hashes")

    def node_by_name(self, qualified_name: str) -> DataFrame:
        return self.nodes().filter(F.col("qualified_name") == qualified_name)

    def node_by_id(self, node_id: int) -> DataFrame:
        return self.nodes().filter(F.col("id") == node_id)

    def edges_from(self, node_id: int) -> DataFrame:
        return self.edges().filter(F.col("source_id") == node_id).orderBy("ord")

    def edges_to(self, node_id: int) -> DataFrame:
        return self.edges().filter(F.col("target_id") == node_id).orderBy("ord")

    def status(self) -> dict:
        if not self.exists():
            return {"indexed": False, "node_count": 0, "edge_count": 0}
        n, m = self.nodes().count(), self.edges().count()
        return {"indexed": n > 0, "node_count": n, "edge_count": m}

    def delete(self) -> bool:
        """Whether there was anything."""
        fs, path = self._fs()
        return bool(fs.delete(path, True))


def list_projects(spark: SparkSession, cache: str) -> list[dict]:
    """Name and counts of each stored graph directly below cache."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())
    return [{"name": name, **Store(spark, f"{cache}/{name}").status()} for name in names if Store(spark, f"{cache}/{name}").exists()]
