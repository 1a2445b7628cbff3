"""Edges and nodes derived from a built graph: tests, routes, similar names, files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.graph_build import parent_of

# Directories of tests, file endings and verbs that frameworks give meaning to.
TEST_DIRS = ("__tests__", "tests", "test", "spec")
VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "all")
FILE_ROUTES = ("/route.ts", "/route.js", "/route.tsx", "/route.jsx", "/+server.ts", "/+server.js", "/+page.server.ts", "/+page.server.js")
ROUTE_ROOTS = ("src/app", "app", "src/routes", "pages/api")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def impl_name(name: Column) -> Column:
    """The file a test file's name points at, else null."""
    script = r"^(.+)\.(?:test|spec)\.(js|ts|tsx|jsx)$"
    return (
        F.when(name.rlike(r"^test_.+\.py$"), F.regexp_replace(name, "^test_", ""))
        .when(name.rlike(r"^.+_test\.py$"), F.regexp_replace(name, r"_test\.py$", ".py"))
        .when(name.rlike(script), F.regexp_replace(name, script, "$1.$2"))
    )


def in_test_dir(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, TEST_DIRS)))


def test_links(files: DataFrame) -> DataFrame:
    """files (path, ord) to (test_path, impl_path): the last other file of the implied name; else, within test
    directories, the last file of the same name outside them."""
    named = files.select("path", "ord", basename(F.col("path")).alias("base"), F.coalesce(in_test_dir(F.col("path")), F.lit(False)).alias("in_tests"))
    wanted = named.withColumn("impl", impl_name(F.col("base")))
    target = named.select(F.col("path").alias("impl_path"), F.col("ord").alias("impl_ord"), F.col("base").alias("impl"), F.col("in_tests").alias("impl_in_tests"))
    last = F.max_by("impl_path", "impl_ord").alias("impl_path")
    by_name = wanted.filter("impl IS NOT NULL").join(target, "impl").filter("path <> impl_path").groupBy(F.col("path").alias("test_path")).agg(last)
    rest = wanted.filter("in_tests").join(by_name.select(F.col("test_path").alias("path")), "path", "left_anti").withColumn("impl", F.col("base"))
    by_dir = rest.join(target.filter("NOT impl_in_tests"), "impl").groupBy(F.col("path").alias("test_path")).agg(last)
    return by_name.unionByName(by_dir)


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^test_", ""), "_test$", ""))


def similar_pairs(items: DataFrame, key: Column, group: str, order: str, only: tuple = ()) -> DataFrame:
    """Pairs (a, b, key) of items with the same key and different groups, a before b by order."""
    keyed = items.select(F.col(order), F.col(group), key.alias("key")).filter("key IS NOT NULL AND key <> ''")
    left = keyed.select(F.col(order).alias("a"), F.col(group).alias("ga"), "key")
    right = keyed.select(F.col(order).alias("b"), F.col(group).alias("gb"), "key")
    return left.join(right, "key").filter("a < b AND NOT (ga <=> gb)").select("a", "b", "key")


def similar_names(nodes: DataFrame) -> DataFrame:
    return similar_pairs(nodes.filter(F.col("label").isin("Function", "Method")), normal_name(F.col("name")), "file_path", "id")


def co_changes(baskets: DataFrame, basket: str = "commit_id", item: str = "path", largest: int = 20, least_pairs: int = 3, least_coupling: float = 0.3) -> DataFrame:
    """Items often in one basket: (item_a, item_b, co_changes, coupling), coupling over the rarer item's baskets.

    Baskets over the largest size are left out before any pair is made, so pairs are bounded for each basket.
    """
    rows = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    small = rows.groupBy("basket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= largest)
    rows = rows.join(small.select("basket"), "basket", "left_semi")
    counts = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    a, b = rows.withColumnRenamed("item", "item_a"), rows.withColumnRenamed("item", "item_b")
    pairs = a.join(b, "basket").filter("item_a < item_b").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("co_changes")).filter(F.col("co_changes") >= least_pairs)
    both = pairs.join(counts.withColumnsRenamed({"item": "item_a", "n": "na"}), "item_a").join(counts.withColumnsRenamed({"item": "item_b", "n": "nb"}), "item_b")
    coupling = F.col("co_changes") / F.least("na", "nb")
    return both.select("item_a", "item_b", "co_changes", coupling.alias("coupling")).filter(F.col("coupling") >= least_coupling)


def property_routes(functions: DataFrame) -> DataFrame:
    """functions (id, route_path, route_method) to (id, method, path), one row a method; GET where none is given."""
    methods = F.filter(F.transform(F.split(F.coalesce("route_method", F.lit("GET")), ","), lambda m: F.trim(m)), lambda m: m != "")
    return functions.filter("route_path IS NOT NULL").select("id", F.explode(methods).alias("method"), F.col("route_path").alias("path"))


def named_routes(functions: DataFrame) -> DataFrame:
    """functions (id, name, file_path) in files of handlers, named get_... to delete_..., to (id, method, path)."""
    verb = F.regexp_extract("name", "^(get|post|put|delete|patch)_", 1)
    rest = F.regexp_replace("name", "^(get|post|put|delete|patch)_", "")
    return functions.filter(F.lower("file_path").rlike("route|controller|handler|view") & (verb != "")).select("id", F.upper(verb).alias("method"), F.concat(F.lit("/"), F.replace(rest, F.lit("_"), F.lit("/"))).alias("path"))


def file_route_path(path: Column) -> Column:
    """The route that a file's directories spell: below a framework's root, [...x] as *x, [x] as :x, (groups) left out."""
    return segment_names(F.split(F.regexp_replace(parent_of(path), "^(" + "|".join(ROUTE_ROOTS) + ")", ""), "/"))


def segment_names(segments: Column) -> Column:
    named = F.transform(
        F.filter(segments, lambda s: (s != "") & ~s.rlike(r"^\(.*\)$")),
        lambda s: F.when(s.rlike(r"^\[\.\.\..*\]$"), F.regexp_replace(s, r"^\[\.\.\.(.*)\]$", "*$1")).when(s.rlike(r"^\[.*\]$"), F.regexp_replace(s, r"^\[(.*)\]$", ":$1")).otherwise(s),
    )
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def file_routes(functions: DataFrame) -> DataFrame:
    """functions (id, name, file_path) named as a verb in files that route by their place, to (id, method, path)."""
    path = F.concat(F.lit("/"), F.col("file_path"))
    is_route = F.lit(False)
    for ending in FILE_ROUTES:
        is_route = is_route | F.endswith(path, F.lit(ending))
    return functions.filter(is_route & F.lower("name").isin(*VERBS)).select("id", F.upper("name").alias("method"), file_route_path(F.col("file_path")).alias("path"))


def routes(functions: DataFrame) -> DataFrame:
    """(id, method, path) of all handlers: by properties, else by name, else by place."""
    a = property_routes(functions)
    rest = functions.join(a.select("id").distinct(), "id", "left_anti")
    b = named_routes(rest)
    c = file_routes(rest.join(b.select("id"), "id", "left_anti"))
    return a.unionByName(b).unionByName(c)


def route_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Route node rows, one for each method and path, and HANDLES edges (source_id, target_qn, method)."""
    qn = F.concat_ws(":", F.lit("route"), F.col("method"), F.col("path"))
    nodes = found.select(qn.alias("qualified_name"), F.lit("Route").alias("label"), F.col("path").alias("name")).distinct()
    return nodes, found.select(F.col("id").alias("source_id"), qn.alias("target_qn"), "method").distinct()
