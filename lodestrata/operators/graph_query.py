"""Questions on a graph of nodes and edges: filtered search, neighbours, summaries, changes, source slices."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY_NAMES = ("main", "__main__", "__init__")
#: Edge types whose presence shows that a definition is used.
USES = ("CALLS", "HANDLES", "TESTS", "TESTS_FILE", "IMPORTS", "USES", "TYPE_REF")


def name_matches(query: str) -> Column:
    """Case-insensitive substring of name or qualified name; '' matches all."""
    return F.contains(F.lower("name"), F.lower(F.lit(query))) | F.contains(F.lower("qualified_name"), F.lower(F.lit(query)))


def is_entry_point() -> Column:
    return F.col("name").isin(*ENTRY_NAMES) | F.startswith("name", F.lit("test_")) | F.startswith("name", F.lit("Test")) | (F.col("label") == "Route")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def search_nodes(
    nodes: DataFrame, edges: DataFrame | None = None, query: str | None = None, label: str | None = None, file_path: str | None = None, name_pattern: str | None = None,
    max_degree: int | None = None, exclude_entry_points: bool = False, relationship: str | None = None, limit: int | None = 50,
) -> DataFrame:
    """Nodes that pass all given filters, the first limit by qualified name, then id. A pattern that is no regex filters nothing."""
    found = nodes
    if query is not None:
        found = found.filter(name_matches(query))
    if label is not None:
        found = found.filter(F.col("label") == label)
    if file_path is not None:
        found = found.filter(F.contains("file_path", F.lit(file_path)))
    if name_pattern is not None and _is_regex(name_pattern):
        found = found.filter(F.col("name").rlike(name_pattern))
    if exclude_entry_points:
        found = found.filter(~is_entry_point())
    if max_degree is not None:
        found = found.join(degrees(edges), "id", "left").filter(F.coalesce("degree", F.lit(0)) <= max_degree).drop("degree")
    if relationship is not None:
        ends = edges.filter(F.col("edge_type") == relationship).select(F.explode(F.array("source_id", "target_id")).alias("id"))
        found = found.join(ends, "id", "left_semi")
    return found if limit is None else found.orderBy("qualified_name", "id").limit(limit)


def _is_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def callers(nodes: DataFrame, edges: DataFrame, qualified_name: str) -> DataFrame:
    """(node columns, confidence) of what calls the named node."""
    target = nodes.filter(F.col("qualified_name") == qualified_name).select(F.col("id").alias("target_id"))
    calls = edges.filter("edge_type = 'CALLS'").join(target, "target_id", "left_semi").select(F.col("source_id").alias("id"), "confidence")
    return nodes.join(calls, "id")


def callees(nodes: DataFrame, edges: DataFrame, qualified_name: str) -> DataFrame:
    source = nodes.filter(F.col("qualified_name") == qualified_name).select(F.col("id").alias("source_id"))
    calls = edges.filter("edge_type = 'CALLS'").join(source, "source_id", "left_semi").select(F.col("target_id").alias("id"), "confidence")
    return nodes.join(calls, "id")


def dead_code(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ("Function", "Method", "Class"), uses: tuple[str, ...] = USES, limit: int | None = 200) -> DataFrame:
    """Definitions that nothing uses and that are no entry points."""
    used = edges.filter(F.col("edge_type").isin(*uses)).select(F.col("target_id").alias("id"))
    found = nodes.filter(F.col("label").isin(*labels) & ~is_entry_point()).join(used, "id", "left_anti")
    return found if limit is None else found.orderBy("qualified_name", "id").limit(limit)


def route_nodes(nodes: DataFrame, edges: DataFrame, limit: int | None = 200) -> DataFrame:
    """Both ends of HANDLES edges."""
    return search_nodes(nodes, edges, relationship="HANDLES", limit=limit)


def route_handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, path, handler) of each HANDLES edge."""
    handlers = nodes.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("handler"))
    paths = nodes.select(F.col("id").alias("target_id"), F.col("qualified_name").alias("route"))
    found = edges.filter("edge_type = 'HANDLES'").join(handlers, "source_id").join(paths, "target_id")
    return found.select(F.split_part("route", F.lit(":"), F.lit(2)).alias("method"), F.regexp_replace("route", "^route:[^:]*:", "").alias("path"), "handler")


def graph_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sorted labels and edge types, counts."""
    a = nodes.agg(F.sort_array(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("node_count"))
    b = edges.agg(F.sort_array(F.collect_set("edge_type")).alias("edge_types"), F.count(F.lit(1)).alias("edge_count"))
    return a.crossJoin(b)


def architecture(nodes: DataFrame, edges: DataFrame, files: int = 20) -> DataFrame:
    """One row: languages, first files, packages, summary, entry points (none, as the contract has it).

    Distinct paths are aggregated before the sort; the file list is a top-k and packages are directories.
    """
    paths = nodes.filter("label = 'File' AND file_path IS NOT NULL").select("file_path").distinct()
    ending = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    language = F.when(ending == "py", "Python").when(ending.isin("js", "jsx", "mjs", "cjs"), "JavaScript").when(ending.isin("ts", "tsx"), "TypeScript")
    first = paths.orderBy("file_path").limit(files).agg(F.sort_array(F.collect_list("file_path")).alias("files"))
    told = paths.agg(F.sort_array(F.collect_set(language)).alias("languages"), F.sort_array(F.collect_set(F.when(F.contains("file_path", F.lit("/")), F.regexp_replace("file_path", "/[^/]*$", "")))).alias("packages"))
    n, m = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))
    summary = F.format_string("%d nodes, %d edges", "n", "m").alias("summary")
    return told.crossJoin(first).crossJoin(n).crossJoin(m).select("languages", "files", "packages", summary, F.array().cast("array<string>").alias("entry_points"))


def index_status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count"))).select((F.col("node_count") > 0).alias("indexed"), "node_count", "edge_count")


def snippet(nodes: DataFrame, files: DataFrame, qualified_name: str, context: int = 3) -> DataFrame:
    """(qualified_name, file_path, start, end, language, source) with context lines around the node's own."""
    found = nodes.filter(F.col("qualified_name") == qualified_name).join(files.select(F.col("rel_path").alias("file_path"), "content"), "file_path")
    lines = F.split(F.regexp_replace("content", r"\n\z", ""), "\n")
    start, end = F.greatest(F.col("line_start") - context, F.lit(1)), F.least(F.col("line_end") + context, F.size(lines))
    found = found.select("qualified_name", "file_path", start.alias("start"), end.alias("end"), F.regexp_extract("file_path", r"\.([^./]+)$", 1).alias("language"), lines.alias("lines"))
    return found.select("qualified_name", "file_path", "start", "end", "language", F.array_join(F.slice("lines", F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))), "\n").alias("source"))


def detect_changes(current: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("rel_path",), marks: tuple[str, ...] = ("mtime_s", "size")) -> DataFrame:
    """(keys, status) of rows that were added, modified or deleted since they were stored."""
    a = current.select(*keys, F.struct(*marks).alias("now"))
    b = stored.select(*keys, F.struct(*marks).alias("then"))
    status = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("then")), "modified")
    return a.join(b, list(keys), "full").select(*keys, status.alias("status")).filter("status IS NOT NULL")


def search_code(files: DataFrame, pattern: str, limit: int | None = 50) -> DataFrame:
    """(rel_path, line, text) of source lines that match; a pattern that is no regex is searched as it stands."""
    lines = files.select("rel_path", F.posexplode(F.split("content", "\n")).alias("at", "text"))
    hit = F.col("text").rlike(pattern) if _is_regex(pattern) else F.contains("text", F.lit(pattern))
    found = lines.filter(hit).select("rel_path", (F.col("at") + 1).alias("line"), "text")
    return found if limit is None else found.orderBy("rel_path", "line").limit(limit)
