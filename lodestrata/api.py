"""One object for all of it: index a repository, ask its graph, compact texts, count what was saved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import commands, compact_json, html, markdown
from lodestrata.functions.output import engine
from lodestrata.operators import graph_query as Q
from lodestrata.operators import traverse as V
from lodestrata.operators import usage as U
from lodestrata.plans import index as I
from lodestrata.sources.files import discover
from lodestrata.sources.store import Store, list_projects


class Workbench:
    def __init__(self, spark: SparkSession, cache: str):
        self.spark, self.cache = spark, cache.rstrip("/")

    def store(self, project: str) -> Store:
        return Store(self.spark, f"{self.cache}/{project}")

    def index_repository(self, path: str, mode: str = "full", commits: DataFrame | None = None, force: bool = False) -> dict:
        """force builds anew even if no file changed."""
        store = self.store(path.rstrip("/").rpartition("/")[2])
        if force or not store.exists():
            return I.index_repository(self.spark, path, store, mode, commits)
        return I.reindex_changed(self.spark, path, store, mode, commits)

    def detect_changes(self, path: str, mode: str = "full") -> DataFrame:
        return I.changed_files(self.spark, path, self.store(path.rstrip("/").rpartition("/")[2]), mode)

    def list_projects(self) -> list[dict]:
        return list_projects(self.spark, self.cache)

    def index_status(self, project: str) -> dict:
        return self.store(project).status()

    def delete_project(self, project: str) -> bool:
        return self.store(project).delete()

    def search_nodes(self, project: str, **filters) -> DataFrame:
        store = self.store(project)
        return Q.search_nodes(store.nodes(), store.edges(), **filters)

    def trace_path(self, project: str, source: str, target: str, max_depth: int = 5) -> DataFrame:
        store = self.store(project)
        return V.trace_path(store.edges(), store.node_by_name(source).select("id"), store.node_by_name(target).select("id"), max_depth)

    def trace_fan(self, project: str, name: str, direction: str = "outbound", depth: int = 3, root: str | None = None, edge_types: tuple[str, ...] | None = None) -> DataFrame:
        """From a qualified or plain name; with root, the source lines of each node."""
        store = self.store(project)
        files = discover(self.spark, root) if root else None
        return V.trace_fan_with_body(store.nodes(), store.edges(), name, direction, depth, files, edge_types)

    def callers(self, project: str, qualified_name: str) -> DataFrame:
        store = self.store(project)
        return Q.callers(store.nodes(), store.edges(), qualified_name)

    def callees(self, project: str, qualified_name: str) -> DataFrame:
        store = self.store(project)
        return Q.callees(store.nodes(), store.edges(), qualified_name)

    def get_snippet(self, project: str, qualified_name: str, root: str, context: int = 3) -> DataFrame:
        return Q.snippet(self.store(project).nodes(), discover(self.spark, root), qualified_name, context)

    def search_code(self, root: str, pattern: str, limit: int = 50) -> DataFrame:
        return Q.search_code(discover(self.spark, root), pattern, limit)

    def get_architecture(self, project: str) -> DataFrame:
        store = self.store(project)
        return Q.architecture(store.nodes(), store.edges())

    def get_graph_schema(self, project: str) -> DataFrame:
        store = self.store(project)
        return Q.graph_schema(store.nodes(), store.edges())

    def find_dead_code(self, project: str, limit: int = 200) -> DataFrame:
        store = self.store(project)
        return Q.dead_code(store.nodes(), store.edges(), limit=limit)

    def find_routes(self, project: str, limit: int = 200) -> DataFrame:
        store = self.store(project)
        return Q.route_nodes(store.nodes(), store.edges(), limit)

    def route_handlers(self, project: str) -> DataFrame:
        store = self.store(project)
        return Q.route_handlers(store.nodes(), store.edges())

    def compacted(self, rows: DataFrame, command: str = "command", text: str = "raw_text") -> DataFrame:
        """rows (command, raw_text) with hint and compact_text, and the facts that usage rollups take."""
        hinted = rows.withColumn("hint", commands.command_hint(rows[command]))
        return hinted.withColumn("compact_text", engine.compact_output_column(hinted[text], hinted["hint"]))

    def savings(self, calls: DataFrame) -> DataFrame:
        return U.usage_rollup(U.record_calls(calls))


def register_functions(spark: SparkSession) -> None:
    """The text operators as SQL functions, in Arrow batches. In DataFrames commands.command_hint needs no Python."""

    def compact(texts: pd.Series) -> pd.Series:
        return pd.Series([engine.compact_output(t) for t in texts], dtype=object)

    def clean(pages: pd.Series) -> pd.Series:
        return pages.map(html.clean_html)

    def match(said: pd.Series) -> pd.Series:
        return pd.Series([commands.match_command(c) for c in said], dtype=object)

    spark.udf.register("compact_json", compact_json._compact_column)
    spark.udf.register("search_markdown", markdown._search_column)
    spark.udf.register("clean_html", F.pandas_udf(clean, "string"))
    spark.udf.register("compact_output", F.pandas_udf(compact, "string"))
    spark.udf.register("match_command", F.pandas_udf(match, "string"))
