"""From source files to a stored graph: extraction, structure, definitions, resolved calls, routes, tests, similarity,
co-changes; whole, or only for files that changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import enrich as E
from lodestrata.operators import graph_build as B
from lodestrata.operators import graph_query as Q
from lodestrata.sources import extract as X
from lodestrata.sources.files import discover, file_hashes
from lodestrata.sources.store import Store
from lodestrata.sources.workspace import shared_dir, written

_NONE = "cast(map() as map<string,string>)"


def _edge_rows(df: DataFrame, kind: str, source: str, target: str, confidence: str = "cast(null as double)", ord_: str = "0L", properties: str = _NONE) -> DataFrame:
    return df.selectExpr(f"{source} AS source_qn", f"{target} AS target_qn", f"'{kind}' AS edge_type", f"{confidence} AS confidence", f"{properties} AS properties", f"{ord_} AS ord")


def build_graph(files: DataFrame, commits: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (project, rel_path, language, content) of one project and commits (commit_ord, path) to (nodes, edges, errors).

    Files are read and parsed once, on the executors; all that follows are joins and aggregations of what was found.
    ord follows the files' paths, then places within a file, so ties are settled as if files were read in order.
    """
    spark = files.sparkSession
    folder = shared_dir(spark)
    found = written(X.extracted(files), folder, "found")
    place = lambda kind: X.exploded(found, kind).withColumn("at", F.struct("project", "rel_path", "ord"))
    defs, calls, imports, hints = (written(place(kind), folder, kind) for kind in ("definitions", "calls", "imports", "hints"))

    files = found.select("project", "rel_path")
    shape_nodes, shape_edges = B.structure(files)
    def_ord = F.struct("rel_path", "ord")
    routes = B.apply_route_hints(
        defs.select("qualified_name", "name", "label", def_ord.alias("ord")),
        hints.select("def_qn", "handler_name", "route_path", "route_method", def_ord.alias("ord")),
    )
    properties = F.when(F.col("route_path").isNotNull(), F.create_map(F.lit("route_path"), F.col("route_path"), F.lit("route_method"), F.coalesce("route_method", F.lit("GET")))).otherwise(F.expr(_NONE))
    one = defs.groupBy("qualified_name").agg(F.max_by(F.struct("label", "name", F.col("rel_path").alias("file_path"), "line_start", "line_end"), F.struct("rel_path", "ord")).alias("d"))
    def_nodes = one.join(routes, "qualified_name", "left").select("qualified_name", "d.*", properties.alias("properties"))
    shape = shape_nodes.drop("ord").dropDuplicates(["qualified_name"])
    nodes = shape.unionByName(def_nodes.select(shape.columns))
    nodes = written(nodes.withColumn("id", B.node_id(F.col("qualified_name"))), folder, "base_nodes")

    defined = defs.select("project", "rel_path", "qualified_name", F.col("ord")).distinct().withColumn("source_qn", B.file_qn(F.col("project"), F.col("rel_path")))
    edges = [shape_edges.withColumn("properties", F.expr(_NONE)), _edge_rows(defined, "CONTAINS_FILE", "source_qn", "qualified_name", ord_="ord")]

    calls = calls.withColumn("call_id", F.xxhash64("project", "rel_path", "ord"))
    known = defs.select("qualified_name", F.col("name").alias("simple_name"), def_ord.alias("key"))
    ranks = known.groupBy("qualified_name", "simple_name").agg(F.min("key").alias("key"))
    by_key = Window.partitionBy("simple_name").orderBy("key", "qualified_name")  # sorted, not gathered: names may be common
    registry = ranks.select("simple_name", "qualified_name", F.row_number().over(by_key).cast("long").alias("ord"))
    resolved = B.resolve_calls(calls.select("call_id", "project", "rel_path", "callee", "caller_qn"), registry, imports.select("rel_path", "module_path", "alias", "names", "ord"))
    resolved = resolved.join(calls.select("call_id", "project", "rel_path", "caller_qn", "ord"), "call_id")
    resolved = resolved.withColumn("source_qn", F.coalesce("caller_qn", B.file_qn(F.col("project"), F.col("rel_path"))))
    edges.append(_edge_rows(resolved, "CALLS", "source_qn", "target_qn", "confidence", "ord"))

    functions = nodes.filter(F.col("label").isin("Function", "Method")).select("id", "qualified_name", "name", "file_path", F.col("properties")["route_path"].alias("route_path"), F.col("properties")["route_method"].alias("route_method"))
    handled = written(E.routes(functions), folder, "routes")
    route_nodes, handles = E.route_graph(handled)
    handles = handles.join(functions.select(F.col("id").alias("source_id"), F.col("qualified_name").alias("source_qn")), "source_id")
    edges.append(_edge_rows(handles, "HANDLES", "source_qn", "target_qn", properties="map('method', method)"))
    nodes = nodes.unionByName(route_nodes.select(B.node_id(F.col("qualified_name")).alias("id"), "label", "name", "qualified_name", F.lit(None).cast("string").alias("file_path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.expr(_NONE).alias("properties")))

    paths = files.select("project", F.col("rel_path").alias("path"), F.struct("rel_path").alias("ord"))
    tests = E.test_links(paths)
    project = str((files.select("project").first() or [""])[0]).replace("'", "\\'")
    qn = lambda c: f"concat_ws('::', '{project}', {c}, '__file__')"
    edges.append(_edge_rows(tests, "TESTS_FILE", qn("test_path"), qn("impl_path")))

    alike = E.similar_names(nodes)
    named = nodes.select("id", "qualified_name")
    alike = alike.join(named.withColumnsRenamed({"id": "a", "qualified_name": "source_qn"}), "a").join(named.withColumnsRenamed({"id": "b", "qualified_name": "target_qn"}), "b")
    edges.append(_edge_rows(alike, "SIMILAR_TO", "source_qn", "target_qn"))

    if commits is not None:
        pairs = E.co_changes(commits, "commit_ord", "path")
        told = "map('co_changes', cast(co_changes as string), 'coupling_score', format_string('%.2f', coupling))"
        edges.append(_edge_rows(pairs, "CO_CHANGED", qn("item_a"), qn("item_b"), properties=told))

    rows = edges[0].select("source_qn", "target_qn", "edge_type", "confidence", "properties", "ord")
    for more in edges[1:]:
        rows = rows.unionByName(more)
    ids = nodes.select("id", "qualified_name")
    rows = rows.join(ids.withColumnsRenamed({"id": "source_id", "qualified_name": "source_qn"}), "source_qn").join(ids.withColumnsRenamed({"id": "target_id", "qualified_name": "target_qn"}), "target_qn")
    return nodes.select("id", "label", "name", "qualified_name", "file_path", "line_start", "line_end", "properties"), B.merge_edges(rows.drop("source_qn", "target_qn")), found.filter("error IS NOT NULL").select("rel_path", "error")


def index_repository(spark: SparkSession, root: str, store: Store, mode: str = "full", commits: DataFrame | None = None) -> dict:
    files = discover(spark, root, mode)
    nodes, edges, errors = build_graph(files, commits)
    store.write(nodes, edges, file_hashes(files))
    return {**store.status(), "files": store.file_hashes().count(), "errors": errors.count()}


def changed_files(spark: SparkSession, root: str, store: Store, mode: str = "full") -> DataFrame:
    """(rel_path, status) against the stored hashes."""
    return Q.detect_changes(file_hashes(discover(spark, root, mode, content=False)), store.file_hashes())


def reindex_changed(spark: SparkSession, root: str, store: Store, mode: str = "full", commits: DataFrame | None = None) -> dict:
    """Builds anew only if some file was added, modified or deleted.

    Calls resolve across files, so a change anywhere can move edges elsewhere; what is spared is the build, not parts
    of it.
    """
    if store.exists() and changed_files(spark, root, store, mode).isEmpty():
        return {**store.status(), "changed": False}
    return {**index_repository(spark, root, store, mode, commits), "changed": True}
