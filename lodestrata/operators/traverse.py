"""Bounded breadth-first search: one join of the frontier with the edges a level, visited nodes left out.

A node keeps the way by which it was found first. Ways are ordered by the order of their edges, compared from the
start on, which is the order in which a queue would find them; no global sort is needed. The adjacency, once, and each
level are written to the shared folder, so edges are worked out once and a lost executor costs at most a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.workspace import shared_dir, written


def _adjacent(edges: DataFrame, direction: str, edge_types: tuple[str, ...] | None) -> DataFrame:
    """(here, there, ord, via) by direction; both walks out-edges of a node before its in-edges."""
    if edge_types is not None:
        edges = edges.filter(F.col("edge_type").isin(*edge_types))
    via = F.struct("source_id", "target_id", "edge_type").alias("via")
    out = edges.select(F.col("source_id").alias("here"), F.col("target_id").alias("there"), F.struct(F.lit(0).alias("side"), F.col("ord").cast("long").alias("ord")).alias("ord"), via)
    into = edges.select(F.col("target_id").alias("here"), F.col("source_id").alias("there"), F.struct(F.lit(1).alias("side"), F.col("ord").cast("long").alias("ord")).alias("ord"), via)
    return {"outbound": out, "inbound": into, "both": out.unionByName(into)}[direction]


def trace_fan(edges: DataFrame, starts: DataFrame, direction: str = "both", depth: int = 3, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """starts (id) to (id, depth, via): every node within depth steps, with the edge that found it first."""
    if direction not in ("outbound", "inbound", "both"):
        raise ValueError(f"no such direction: {direction}")
    folder = shared_dir(edges.sparkSession)
    steps = written(_adjacent(edges, direction, edge_types), folder, "steps")
    root = starts.select("id", F.lit(0).alias("depth"), F.expr("cast(null as struct<source_id:bigint,target_id:bigint,edge_type:string>)").alias("via"), F.expr("cast(array() as array<struct<side:int,ord:bigint>>)").alias("rank"))
    seen = frontier = written(root.dropDuplicates(["id"]), folder, "level0")
    for level in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("here"), "rank").join(steps, "here").select(F.col("there").alias("id"), F.concat("rank", F.array("ord")).alias("rank"), "via")
        fresh = reached.join(seen.select("id"), "id", "left_anti")
        first = fresh.groupBy("id").agg(F.min_by(F.struct("via", "rank"), F.struct("rank", "via")).alias("best"))
        frontier = written(first.select("id", F.lit(level).alias("depth"), "best.via", "best.rank"), folder, f"level{level}")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("id", "depth", "via")


def trace_path(edges: DataFrame, source: DataFrame, target: DataFrame, max_depth: int = 5) -> DataFrame:
    """source and target (id) of one row each to (depth, id, via): the shortest directed way, first by edge order.

    No way within max_depth steps, or a missing end: no rows. From a node to itself: its shortest cycle.
    """
    folder = shared_dir(edges.sparkSession)
    steps = written(_adjacent(edges, "outbound", None), folder, "steps")
    empty = F.expr("cast(array() as array<struct<ord:struct<side:int,ord:bigint>,via:struct<source_id:bigint,target_id:bigint,edge_type:string>>>)")
    seen = frontier = written(source.select("id", empty.alias("way")), folder, "level0")
    goal = target.select("id")
    found = None
    visited = None
    for level in range(1, max_depth + 1):
        reached = frontier.select(F.col("id").alias("here"), "way").join(steps, "here").select(F.col("there").alias("id"), F.concat("way", F.array(F.struct("ord", "via"))).alias("way"))
        if visited is not None:
            reached = reached.join(visited, "id", "left_anti")
        first = reached.groupBy("id").agg(F.min("way").alias("way"))
        frontier = written(first, folder, f"level{level}")
        hit = frontier.join(goal, "id", "left_semi")
        if not hit.isEmpty():
            found = hit
            break
        if frontier.isEmpty():
            break
        visited = frontier.select("id") if visited is None else visited.union(frontier.select("id"))
    if found is None:
        found = seen.limit(0)
    walked = found.select(F.posexplode(F.concat(F.array(F.expr("cast(null as struct<ord:struct<side:int,ord:bigint>,via:struct<source_id:bigint,target_id:bigint,edge_type:string>>)")), F.col("way"))).alias("depth", "step"), F.col("way")[0]["via"]["source_id"].alias("origin"))
    return walked.select("depth", F.coalesce("step.via.target_id", "origin").alias("id"), F.col("step.via").alias("via"))


LABEL_RANK = ("Function", "Method", "Class")


def resolve_start(nodes: DataFrame, name: str) -> DataFrame:
    """One row (id) for a qualified name, else an exact name, else a case-insensitive part of a name; functions come
    before methods and classes, then by qualified name and id. No row if nothing fits."""
    way = F.when(F.col("qualified_name") == name, 0).when(F.col("name") == name, 1).when(F.contains(F.lower("name"), F.lower(F.lit(name))), 2)
    rank = F.coalesce(*[F.when(F.col("label") == label, k) for k, label in enumerate(LABEL_RANK)], F.lit(len(LABEL_RANK)))
    return nodes.withColumn("way", way).filter("way IS NOT NULL").orderBy("way", rank, "qualified_name", "id").limit(1).select("id")


def trace_fan_with_body(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "outbound", depth: int = 3, files: DataFrame | None = None, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of trace_fan from the node a name resolves to, with node columns and, given files, its source lines."""
    found = trace_fan(edges, resolve_start(nodes, name), direction, depth, edge_types).join(nodes, "id")
    if files is None:
        return found.withColumn("body", F.lit(None).cast("string"))
    source = files.select(F.col("rel_path").alias("file_path"), F.split("content", "\n").alias("lines"))
    body = F.when(F.col("line_start") > 0, F.array_join(F.slice("lines", F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "\n"))
    return found.join(source, "file_path", "left").withColumn("body", body).drop("lines")
