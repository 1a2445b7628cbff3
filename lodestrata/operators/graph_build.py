"""Construction of the property graph: merged nodes and edges, folder chains, definitions, routes, resolved calls.

Ids are hashes of qualified names, so they need no global order; order that results depend on is a column, ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata import schema as S


def node_id(qualified_name: Column) -> Column:
    return F.xxhash64(qualified_name)


def merged_properties(rows: DataFrame, keys: list[str], properties: str = "properties", order: str = "ord") -> DataFrame:
    """One map for each key: of each property the value that was written last. Writers of a property meet in pairs,
    not in one list, however many there are."""
    each = rows.select(*keys, order, F.explode(properties).alias("k", "v"))
    last = each.groupBy(*keys, "k").agg(F.max_by("v", F.struct(order, "v")).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(properties))


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """rows (qualified_name, label, name, file_path, line_start, line_end, properties, ord) to one node for each
    qualified name: its first ord, the last writer's fields (of writers with the same ord the greatest), all writers'
    properties."""
    fields = F.struct("label", "name", "file_path", "line_start", "line_end")
    merged = rows.groupBy("qualified_name").agg(F.min("ord").alias("ord"), F.max_by(fields, F.struct(F.col("ord"), fields)).alias("last"))
    properties = merged_properties(rows, ["qualified_name"])
    out = merged.join(properties, "qualified_name", "left").select(
        node_id(F.col("qualified_name")).alias("id"), "last.*", "qualified_name", "ord", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties")
    )
    return out.select("id", "label", "name", "qualified_name", "file_path", "line_start", "line_end", "properties", "ord")


def merge_edges(rows: DataFrame) -> DataFrame:
    """rows (source_id, target_id, edge_type, confidence, properties, ord) to one edge for each triple: the greatest
    confidence (null is least), the first ord, all properties. One pass: each property is a row with the edge's other
    columns, and edges without any have one with a null key, so partial aggregation still combines on the map side."""
    keys = ["source_id", "target_id", "edge_type"]
    each = rows.select(*keys, "confidence", "ord", F.explode_outer("properties").alias("k", "v"))
    last = each.groupBy(*keys, "k").agg(F.max("confidence").alias("confidence"), F.min("ord").alias("first"), F.max_by("v", F.struct("ord", "v")).alias("v"))
    entries = F.array_sort(F.filter(F.collect_list(F.struct("k", "v")), lambda x: x["k"].isNotNull()))
    merged = last.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.min("first").alias("ord"), entries.alias("entries"))
    return merged.select(*keys, "confidence", F.map_from_entries("entries").cast("map<string,string>").alias("properties"), "ord")


def merge_graphs(main: DataFrame, other: DataFrame) -> DataFrame:
    """Union of node rows, those of other written after those of main; ids of equal names are equal already."""
    end = main.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("__end"))
    return upsert_nodes(main.drop("id").unionByName(other.drop("id").crossJoin(F.broadcast(end)).withColumn("ord", F.col("ord") + F.col("__end")).drop("__end")))


def set_node_property(nodes: DataFrame, qualified_name: str, key: str, value: str) -> DataFrame:
    put = F.map_concat(F.map_filter("properties", lambda k, _: k != key), F.create_map(F.lit(key), F.lit(value)))
    return nodes.withColumn("properties", F.when(F.col("qualified_name") == qualified_name, put).otherwise(F.col("properties")))


def prefixes(path: Column) -> Column:
    """All proper directories of a path, shortest first."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def parent_of(path: Column) -> Column:
    """The directory of a path, '' at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def folder_links(paths: DataFrame, path: str = "rel_path") -> DataFrame:
    """Distinct (parent, child, edge_type) of the folder chain above each path; the root's name is ''."""
    chain = F.concat(prefixes(F.col(path)), F.array(F.col(path)))
    each = paths.select(F.posexplode(chain).alias("at", "child"), F.size(chain).alias("n")).filter("child IS NOT NULL")
    kind = F.when(F.col("at") == F.col("n") - 1, "CONTAINS_FILE").otherwise("CONTAINS_FOLDER")
    return each.select(parent_of(F.col("child")).alias("parent"), "child", kind.alias("edge_type")).distinct()


def file_qn(project: Column, rel_path: Column) -> Column:
    return F.concat_ws("::", project, rel_path, F.lit("__file__"))


def structure(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Project, folder and file node rows, and edge rows by qualified name (source_qn, target_qn, edge_type, confidence, ord)."""
    links = files.select("project", "rel_path").distinct()
    chain = F.concat(prefixes(F.col("rel_path")), F.array(F.col("rel_path")))
    each = links.select("project", "rel_path", F.explode(chain).alias("child"))
    each = each.select("project", "child", (F.col("child") == F.col("rel_path")).alias("is_file")).distinct()
    folder_qn = lambda p: F.concat_ws("::", F.col("project"), F.lit("__folder__"), p)
    qn = F.when(F.col("is_file"), file_qn(F.col("project"), F.col("child"))).otherwise(folder_qn(F.col("child")))
    parent = parent_of(F.col("child"))
    base = F.substring_index("child", "/", -1)
    none = F.create_map().cast("map<string,string>")
    nodes = each.select(
        qn.alias("qualified_name"), F.when(F.col("is_file"), "File").otherwise("Folder").alias("label"), base.alias("name"), F.when(F.col("is_file"), F.col("child")).alias("file_path"),
        F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), none.alias("properties"), F.lit(1).cast("long").alias("ord"),
    )
    projects = files.select("project").distinct().select(
        F.col("project").alias("qualified_name"), F.lit("Project").alias("label"), F.col("project").alias("name"), F.lit(None).cast("string").alias("file_path"),
        F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), none.alias("properties"), F.lit(0).cast("long").alias("ord"),
    )
    edges = each.select(
        F.when(parent == "", F.col("project")).otherwise(folder_qn(parent)).alias("source_qn"), qn.alias("target_qn"),
        F.when(F.col("is_file"), "CONTAINS_FILE").otherwise("CONTAINS_FOLDER").alias("edge_type"), F.lit(None).cast("double").alias("confidence"), F.lit(0).cast("long").alias("ord"),
    )
    return projects.unionByName(nodes), edges


def apply_route_hints(defs: DataFrame, hints: DataFrame) -> DataFrame:
    """(qualified_name, route_path, route_method) of the definitions that hints (def_qn, handler_name, route_path,
    route_method, ord) name: by qualified name, else the first Function or Method of the handler's name. The last
    path stays; methods are listed in order, each once."""
    by_qn = hints.join(defs.select(F.col("qualified_name").alias("def_qn")), "def_qn", "left_semi").withColumn("qualified_name", F.col("def_qn"))
    first = defs.filter(F.col("label").isin("Function", "Method")).groupBy(F.col("name").alias("handler_name")).agg(F.min_by("qualified_name", "ord").alias("qualified_name"))
    by_name = hints.join(defs.select(F.col("qualified_name").alias("def_qn")), "def_qn", "left_anti").join(first, "handler_name")
    columns = ["qualified_name", "route_path", "route_method", "ord"]
    found = by_qn.select(columns).unionByName(by_name.select(columns))
    methods = F.array_sort(F.collect_list(F.struct("ord", "route_method")))
    return found.groupBy("qualified_name").agg(F.max_by("route_path", "ord").alias("route_path"), F.array_join(F.array_distinct(F.transform(methods, lambda m: m["route_method"])), ",").alias("route_method"))


def simple_name(qn: Column) -> Column:
    """What follows the last '.', then the last '::'."""
    return F.element_at(F.split(F.substring_index(qn, ".", -1), "::"), -1)


#: Qualified names agree in fewer characters than twice this.
LONGEST_STEP = 1024


def with_common_prefix(rows: DataFrame, a: str, b: str, name: str, where: Column) -> DataFrame:
    """rows with the length of the common prefix of columns a and b, where wanted, else 0: by halving, a step a column,
    as whole prefixes agree up to that length and disagree beyond it."""
    rows, step = rows.withColumn(name, F.lit(0)), LONGEST_STEP
    while step:
        more = F.col(name) + step
        agree = where & (more <= F.least(F.length(a), F.length(b))) & (F.left(F.col(a), more) == F.left(F.col(b), more))
        rows, step = rows.withColumn(name, F.when(agree, more).otherwise(F.col(name))), step // 2
    return rows


def resolve_calls(calls: DataFrame, defs: DataFrame, imports: DataFrame, strict_imports: bool = False) -> DataFrame:
    """calls (call_id, project, rel_path, callee, caller_qn) to (call_id, target_qn, confidence, strategy).

    defs (qualified_name, simple_name, ord), imports (rel_path, module_path, alias, names, ord). One join on the
    simple name makes the candidates of each distinct question (file, callee, caller); each gets the best strategy that
    admits it, and a question takes its best one: import map, same module, unique name, then the longest common prefix
    with the caller, the last on ties. An imported dotted module also stands
    for its path unless strict_imports.
    """
    named = imports.select("rel_path", "module_path", F.col("ord").alias("import_ord"), F.explode(F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.filter(F.array("alias"), lambda x: x.isNotNull())))).alias("callee"))
    named = named.groupBy("rel_path", "callee").agg(F.collect_list(F.struct("import_ord", "module_path")).alias("modules"))
    counted = defs.groupBy("simple_name").agg(F.count(F.lit(1)).alias("n"))
    question = ["project", "rel_path", "callee", "caller_qn"]
    asked = calls.select(*question).distinct().withColumn("question", F.xxhash64(*question))
    known = defs.select(F.col("simple_name").alias("callee"), F.col("qualified_name").alias("target_qn"), F.col("ord").alias("def_ord"))
    candidates = asked.join(known, "callee").join(counted.withColumnRenamed("simple_name", "callee"), "callee").join(named, ["rel_path", "callee"], "left")
    hits = lambda m: F.col("target_qn").contains(m["module_path"]) | (F.lit(not strict_imports) & F.col("target_qn").contains(F.replace(m["module_path"], F.lit("."), F.lit("/"))))
    import_ord = F.array_min(F.transform(F.filter("modules", hits), lambda m: m["import_ord"]))
    same = F.startswith(F.col("target_qn"), F.concat_ws("::", F.col("project"), F.col("rel_path"), F.lit("")))
    rank = F.when(import_ord.isNotNull(), 1).when(same, 2).when(F.col("n") == 1, 3).otherwise(4)
    last = F.col("rank") == 4
    candidates = candidates.withColumn("rank", rank).withColumn("import_first", import_ord).withColumn("caller", F.coalesce("caller_qn", file_qn(F.col("project"), F.col("rel_path"))))
    candidates = with_common_prefix(candidates, "target_qn", "caller", "prefix", last)
    tie = F.struct(F.when(last, -F.col("prefix")).otherwise(F.coalesce("import_first", F.lit(0))).cast("long").alias("first"), F.when(last, -F.col("def_ord")).otherwise(F.col("def_ord")).alias("then"))
    best = candidates.withColumn("tie", tie).groupBy("question").agg(F.min_by(F.struct("target_qn", "rank"), F.struct("rank", "tie")).alias("best"))
    best = calls.select("call_id", F.xxhash64(*question).alias("question")).join(best, "question")
    confidence = F.element_at(F.array(*[F.lit(c) for c in (S.IMPORT_MAP, S.SAME_MODULE, S.UNIQUE_NAME, S.SUFFIX_MATCH)]), F.col("best.rank"))
    strategy = F.element_at(F.array(*map(F.lit, ("import_map", "same_module", "unique_name", "suffix_match"))), F.col("best.rank"))
    return best.select("call_id", "best.target_qn", confidence.alias("confidence"), strategy.alias("strategy"))
