"""Graph operators over the star schema's graph, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import schema as S
from lodestrata.operators import enrich as E
from lodestrata.operators import graph_build as B
from lodestrata.operators import graph_query as Q
from lodestrata.operators import traverse as V
from lodestrata.plans import star_graph as G
from lodestrata.plans.star_graph import table
from lodestrata.sources.files import language

WITH = f"WITH nodes AS ({G.NODES_SQL}), edges AS ({G.EDGES_SQL})"
WITH_R = WITH.replace("WITH nodes", "WITH RECURSIVE nodes")
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def kept(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return kept


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "label", "name", "qualified_name")


@query(f"{WITH} SELECT id, label, name, qualified_name FROM nodes WHERE contains(lower(name), 'an') OR contains(lower(qualified_name), 'an') ORDER BY qualified_name, id LIMIT 50")
def search_nodes_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(Q.search_nodes(G.nodes(spark, sf_dir), query="AN"))


@query(f"{WITH} SELECT id, label, name, qualified_name FROM nodes WHERE regexp_matches(name, '00[0-9]*7$') ORDER BY qualified_name, id LIMIT 200")
def search_nodes_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(Q.search_nodes(G.nodes(spark, sf_dir), name_pattern="00[0-9]*7$", limit=200))


@query(f"{WITH} SELECT id, label, name, qualified_name FROM nodes WHERE label = 'Class' AND contains(file_path, 'supp')")
def search_nodes_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(Q.search_nodes(G.nodes(spark, sf_dir), label="Class", file_path="supp", limit=None))


@query(f"{WITH} SELECT label, count(*) AS n FROM nodes WHERE NOT (name IN ('main', '__main__', '__init__') OR starts_with(name, 'test_') OR starts_with(name, 'Test') OR label = 'Route') GROUP BY label")
def exclude_entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.search_nodes(G.nodes(spark, sf_dir), exclude_entry_points=True, limit=None).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id)
SELECT id, label, name, qualified_name FROM nodes LEFT JOIN deg USING (id) WHERE coalesce(degree, 0) <= 8 AND label IN ('Function') """)
def degree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(Q.search_nodes(G.nodes(spark, sf_dir), G.edges(spark, sf_dir), label="Function", max_degree=8, limit=None))


@query(f"{WITH} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id")
def node_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.degrees(G.edges(spark, sf_dir))


@query(f"{WITH} SELECT id, label, name, qualified_name FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE edge_type = 'HANDLES' UNION SELECT target_id FROM edges WHERE edge_type = 'HANDLES')")
def relationship_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(Q.route_nodes(G.nodes(spark, sf_dir), G.edges(spark, sf_dir), limit=None))


_USED = "edge_type = 'CALLS' AND ord % 23 = 0"


@query(f"{WITH} SELECT id, label, name, qualified_name FROM nodes WHERE label IN ('Method', 'Function') AND NOT (label = 'Function' AND id % 3 = 0) AND id NOT IN (SELECT target_id FROM edges WHERE {_USED})")
def dead_nodes_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over some of the calls, with every third customer named as an entry point."""
    nodes, edges = G.nodes(spark, sf_dir), G.edges(spark, sf_dir).filter(_USED)
    entry = (F.col("label") == "Function") & (F.col("id") % 3 == 0)
    marked = nodes.withColumn("plain", F.col("name")).withColumn("name", F.when(entry, "main").otherwise(F.col("name")))
    return _ids(Q.dead_code(marked, edges, labels=("Method", "Function"), limit=None).withColumn("name", F.col("plain")))


@query(f"{WITH} SELECT n.id, n.name, e.confidence FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'CALLS' AND e.target_id IN (SELECT id FROM nodes WHERE qualified_name = (SELECT min(qualified_name) FROM nodes WHERE label = 'Method'))")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first part name, which many parts can share."""
    nodes = G.nodes(spark, sf_dir)
    first = nodes.filter("label = 'Method'").agg(F.min("qualified_name")).first()[0]
    return Q.callers(nodes, G.edges(spark, sf_dir), first).select("id", "name", "confidence")


@query(f"{WITH} SELECT n.id, n.name, e.confidence FROM edges e JOIN nodes n ON n.id = e.target_id JOIN nodes s ON s.id = e.source_id WHERE e.edge_type = 'CALLS' AND s.qualified_name = (SELECT min(qualified_name) FROM nodes WHERE label = 'Class')")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.nodes(spark, sf_dir)
    first = nodes.filter("label = 'Class'").agg(F.min("qualified_name")).first()[0]
    return Q.callees(nodes, G.edges(spark, sf_dir), first).select("id", "name", "confidence")


def _fan_sql(start: str, depth: int, both: bool, inbound: bool = False) -> str:
    out, into = "SELECT source_id AS a, target_id AS b FROM edges", "SELECT target_id AS a, source_id AS b FROM edges"
    adj = f"{out} UNION {into}" if both else into if inbound else out
    return f"""{WITH_R}, adj AS ({adj}), walk(id, depth) AS (SELECT {start}, 0 UNION SELECT adj.b, walk.depth + 1 FROM walk JOIN adj ON adj.a = walk.id WHERE walk.depth < {depth})
    SELECT id, min(depth)::BIGINT AS depth FROM walk GROUP BY id"""


def _start(spark: SparkSession, value: int) -> DataFrame:
    return spark.range(1).select(F.lit(value).cast("long").alias("id"))


def _fan(spark: SparkSession, sf_dir: str, start: int, direction: str, depth: int) -> DataFrame:
    return V.trace_fan(G.edges(spark, sf_dir), _start(spark, start), direction, depth).select("id", F.col("depth").cast("long").alias("depth"))


@query(_fan_sql("1::BIGINT", 3, False))
def trace_fan_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan(spark, sf_dir, 1, "outbound", 3)


@query(_fan_sql(f"{G.OFFSETS['part'] + 1}::BIGINT", 3, False, True))
def trace_fan_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan(spark, sf_dir, G.OFFSETS["part"] + 1, "inbound", 3)


@query(_fan_sql("1003::BIGINT", 2, True))
def trace_fan_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan(spark, sf_dir, 1003, "both", 2)


@query(f"""{WITH_R}, goal AS (SELECT {G.OFFSETS['part']} + 1 AS g), walk(id, depth) AS (SELECT r_regionkey::BIGINT, 0 FROM region UNION SELECT e.target_id, walk.depth + 1 FROM walk JOIN edges e ON e.source_id = walk.id WHERE walk.depth < 4 AND e.edge_type <> 'HANDLES')
SELECT min(depth)::BIGINT AS hops FROM walk, goal WHERE id = g""")
def trace_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of the shortest way from any region to the first part."""
    edges = G.edges(spark, sf_dir).filter("edge_type <> 'HANDLES'")
    way = V.trace_path(edges, table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id")), _start(spark, G.OFFSETS["part"] + 1), 4)
    return way.agg(F.max("depth").cast("long").alias("hops"))


_SORTED = "array_to_string(list_sort(list(DISTINCT {0})), ',')"


@query(f"{WITH} SELECT {_SORTED.format('label')} AS labels, count(*) AS node_count, (SELECT {_SORTED.format('edge_type')} FROM edges) AS edge_types, (SELECT count(*) FROM edges) AS edge_count FROM nodes")
def graph_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.graph_schema(G.nodes(spark, sf_dir), G.edges(spark, sf_dir))
    return found.withColumn("labels", F.array_join("labels", ",")).withColumn("edge_types", F.array_join("edge_types", ","))


_PAGE_PATH = r"regexp_replace(url, '^.*?://|[?#].*$|/$', '', 'g')"


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"^.*?://|[?#].*$|/$", "")
    return table(spark, sf_dir, "pages").select(F.lit("web").alias("project"), path.alias("rel_path"))


_ENDINGS = (".py", ".js", ".mjs", ".tsx", ".ts", ".txt", "")


@query(f"""WITH f AS (SELECT DISTINCT {_PAGE_PATH} AS p FROM pages), e AS (SELECT p || {list(_ENDINGS)}[length(p) % {len(_ENDINGS)} + 1] AS path FROM f)
SELECT CASE WHEN ends_with(path, '.py') THEN 'Python' WHEN ends_with(path, 'js') THEN 'JavaScript' WHEN ends_with(path, '.tsx') THEN 'Tsx' WHEN ends_with(path, '.ts') THEN 'TypeScript' END AS language, count(*) AS n FROM e GROUP BY 1""")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _page_files(spark, sf_dir).select("rel_path").distinct()
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.length("rel_path") % len(_ENDINGS) + 1).cast("int"))
    return files.groupBy(language(F.concat("rel_path", ending)).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, f AS (SELECT DISTINCT {_PAGE_PATH} AS p FROM pages), page_files AS (SELECT p || {list(_ENDINGS)}[length(p) % {len(_ENDINGS)} + 1] AS p FROM f), paths AS (SELECT p FROM page_files UNION SELECT file_path FROM nodes WHERE label = 'File'),
packages AS (SELECT DISTINCT regexp_replace(p, '/[^/]*$', '') AS d FROM paths WHERE contains(p, '/')),
languages AS (SELECT DISTINCT CASE WHEN ends_with(p, '.py') THEN 'Python' WHEN ends_with(p, 'js') THEN 'JavaScript' WHEN ends_with(p, '.tsx') OR ends_with(p, '.ts') THEN 'TypeScript' END AS l FROM paths)
SELECT (SELECT string_agg(l, ',' ORDER BY l) FROM languages) AS languages, (SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT p FROM paths ORDER BY p LIMIT 20)) AS files, (SELECT count(*) FROM packages) AS n_packages,
       ((SELECT count(*) FROM page_files) + (SELECT count(*) FROM nodes))::VARCHAR || ' nodes, ' || (SELECT count(*) FROM edges) || ' edges' AS summary, 0::BIGINT AS n_entry_points""")
def architecture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.length("rel_path") % len(_ENDINGS) + 1).cast("int"))
    files = _page_files(spark, sf_dir).select("rel_path").distinct().select(F.lit("File").alias("label"), F.concat("rel_path", ending).alias("file_path"))
    nodes = files.unionByName(G.nodes(spark, sf_dir).select("label", "file_path"))
    found = Q.architecture(nodes, G.edges(spark, sf_dir))
    return found.select(
        F.array_join("languages", ",").alias("languages"), F.array_join("files", "|").alias("files"), F.size("packages").cast("long").alias("n_packages"),
        "summary", F.size("entry_points").cast("long").alias("n_entry_points"),
    )


@query("""WITH t AS (SELECT role AS qualified_name, text AS name, turn AS line, conv_id * 10000 + turn AS ord FROM conversations)
SELECT qualified_name, min(ord) AS ord, arg_max(line, ord)::BIGINT AS line_start, max(ord) AS last_ord, count(DISTINCT line)::BIGINT AS n_properties FROM t GROUP BY qualified_name""")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    ord_ = (F.col("conv_id") * 10000 + F.col("turn")).alias("ord")
    rows = turns.select(
        F.col("role").alias("qualified_name"), F.lit("Function").alias("label"), F.lit("x").alias("name"), F.lit("f").alias("file_path"), F.col("turn").cast("int").alias("line_start"),
        F.lit(0).alias("line_end"), F.create_map(F.col("turn").cast("string"), ord_.cast("string")).alias("properties"), ord_,
    )
    merged = B.upsert_nodes(rows)
    last = F.array_max(F.transform(F.map_values("properties"), lambda v: v.cast("long")))
    return merged.select("qualified_name", "ord", F.col("line_start").cast("long").alias("line_start"), last.alias("last_ord"), F.size("properties").cast("long").alias("n_properties"))


@query("""SELECT l_suppkey AS source_id, l_partkey % 50 AS target_id, CASE WHEN l_returnflag = 'N' THEN 'CALLS' ELSE 'USES' END AS edge_type, max(l_discount) AS confidence, min(l_orderkey) AS ord, count(DISTINCT l_linestatus)::BIGINT AS n_properties
FROM lineitem GROUP BY 1, 2, 3""")
def merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "N", "CALLS").otherwise("USES")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") % 50).alias("target_id"), kind.alias("edge_type"), F.col("l_discount").alias("confidence"),
        F.create_map("l_linestatus", F.lit("1")).alias("properties"), F.col("l_orderkey").alias("ord"),
    )
    return B.merge_edges(rows).select("source_id", "target_id", "edge_type", "confidence", "ord", F.size("properties").cast("long").alias("n_properties"))


@query(f"""WITH f AS (SELECT DISTINCT {_PAGE_PATH} AS p FROM pages), parts AS (SELECT p, string_split(p, '/') AS s FROM f),
chain AS (SELECT p, i, array_to_string(s[1:i], '/') AS child, CASE WHEN i > 1 THEN array_to_string(s[1:i-1], '/') ELSE '' END AS parent, len(s) AS n FROM parts, unnest(range(1, len(s) + 1)) t(i))
SELECT DISTINCT parent, child, CASE WHEN i = n THEN 'CONTAINS_FILE' ELSE 'CONTAINS_FOLDER' END AS edge_type FROM chain""")
def folder_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.folder_links(_page_files(spark, sf_dir))


_SEGMENT = "CASE WHEN regexp_full_match(s, '[0-9]+') THEN '[id]' WHEN regexp_full_match(s, '[0-9]+\\.html') THEN '[...rest]' WHEN s IN ('de', 'fr') THEN '(' || s || ')' ELSE s END"


@query(f"""WITH f AS (SELECT DISTINCT {_PAGE_PATH} AS p FROM pages), seg AS (SELECT p, list_transform(string_split(p, '/')[2:], lambda s: {_SEGMENT}) AS t FROM f)
SELECT p AS path, '/' || array_to_string(list_transform(list_filter(t, lambda s: s <> '' AND NOT regexp_full_match(s, '\\(.*\\)')), lambda s:
  CASE WHEN regexp_full_match(s, '\\[\\.\\.\\..*\\]') THEN '*' || s[5:-2] WHEN regexp_full_match(s, '\\[.*\\]') THEN ':' || s[2:-2] ELSE s END), '/') AS route FROM seg""")
def route_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _page_files(spark, sf_dir).select(F.col("rel_path").alias("path")).distinct()
    parts = F.split("path", "/")
    segments = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda s: F.when(s.rlike("^[0-9]+$"), "[id]").when(s.rlike(r"^[0-9]+\.html$"), "[...rest]").when(s.isin("de", "fr"), F.concat(F.lit("("), s, F.lit(")"))).otherwise(s),
    )
    return files.select("path", E.segment_names(segments).alias("route"))


@query("""SELECT event_id AS id, trim(m) AS method, '/' || event_type AS path FROM (SELECT event_id, event_type, unnest(string_split(CASE WHEN user_id % 3 = 0 THEN 'GET' WHEN user_id % 3 = 1 THEN 'GET, POST' ELSE 'PUT,,DELETE' END, ',')) AS m FROM events) WHERE trim(m) <> ''""")
def route_methods_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    method = F.when(F.col("user_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("user_id") % 3 == 1, "GET, POST").otherwise("PUT,,DELETE")
    return E.property_routes(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("/"), "event_type").alias("route_path"), method.alias("route_method")))


@query("""SELECT method, path, count(*) AS n FROM (SELECT upper(split_part(k, '_', 1)) AS method, '/' || replace(substr(k, strpos(k, '_') + 1), '_', '/') AS path FROM
(SELECT (CASE user_id % 4 WHEN 0 THEN 'get_' WHEN 1 THEN 'post_' WHEN 2 THEN 'make_' ELSE 'delete_' END) || event_type || '_' || (user_id % 7) AS k FROM events) WHERE k NOT LIKE 'make%') GROUP BY ALL""")
def route_prefix_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    verb = F.element_at(F.array(*map(F.lit, ("get_", "post_", "make_", "delete_"))), (F.col("user_id") % 4 + 1).cast("int"))
    functions = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(verb, "event_type", F.lit("_"), (F.col("user_id") % 7).cast("string")).alias("name"), F.lit("src/Handlers/x.py").alias("file_path"))
    return E.named_routes(functions).groupBy("method", "path").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, source, md5(lower(trim(text))) AS key FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON a.key = b.key AND a.doc_id < b.doc_id AND a.source IS DISTINCT FROM b.source""")
def similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.similar_pairs(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), F.md5(F.lower(F.trim("text")).cast("binary")), "source", "doc_id").select("a", "b")


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS k, p_brand AS i FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT k FROM r GROUP BY k HAVING count(*) <= 20), q AS (SELECT * FROM r WHERE k IN (SELECT k FROM s)),
c AS (SELECT i, count(*) AS n FROM q GROUP BY i), p AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS co_changes FROM q a JOIN q b ON a.k = b.k AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT item_a, item_b, co_changes, printf('%.2f', co_changes / least(x.n, y.n)) AS coupling_score FROM p JOIN c x ON x.i = item_a JOIN c y ON y.i = item_b WHERE co_changes / least(x.n, y.n) >= 0.15""")
def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return E.co_changes(rows, "l_orderkey", "p_brand", least_coupling=0.15).select("item_a", "item_b", "co_changes", F.format_string("%.2f", "coupling").alias("coupling_score"))


_TEST_FILES = """SELECT DISTINCT CASE part % 4 WHEN 0 THEN 'src/' || n || '.py' WHEN 1 THEN 'tests/test_' || n || '.py' WHEN 2 THEN 'src/' || n || '_test.py' ELSE 'tests/' || n || '.py' END AS path, part AS ord
FROM (SELECT p_partkey AS part, 'm' || (p_partkey // 4 % 97) AS n FROM part)"""


@query(f"""WITH f AS (SELECT path, max(ord) AS ord FROM ({_TEST_FILES}) GROUP BY path), b AS (SELECT *, split_part(path, '/', -1) AS base, path LIKE 'tests/%' AS intest FROM f),
w AS (SELECT *, CASE WHEN base LIKE 'test\\_%.py' ESCAPE '\\' THEN base[6:] WHEN base LIKE '%\\_test.py' ESCAPE '\\' THEN replace(base, '_test.py', '.py') END AS impl FROM b),
n AS (SELECT w.path AS test_path, arg_max(t.path, t.ord) AS impl_path FROM w JOIN b t ON t.base = w.impl AND t.path <> w.path GROUP BY w.path),
d AS (SELECT w.path AS test_path, arg_max(t.path, t.ord) AS impl_path FROM w JOIN b t ON t.base = w.base AND NOT t.intest WHERE w.intest AND w.path NOT IN (SELECT test_path FROM n) GROUP BY w.path)
SELECT * FROM n UNION ALL SELECT * FROM d""")
def tests_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("p_partkey")
    n = F.concat(F.lit("m"), (F.floor(part / 4) % 97).cast("string"))
    path = F.when(part % 4 == 0, F.concat(F.lit("src/"), n, F.lit(".py"))).when(part % 4 == 1, F.concat(F.lit("tests/test_"), n, F.lit(".py"))).when(part % 4 == 2, F.concat(F.lit("src/"), n, F.lit("_test.py"))).otherwise(F.concat(F.lit("tests/"), n, F.lit(".py")))
    files = table(spark, sf_dir, "part").select(path.alias("path"), part.alias("ord")).groupBy("path").agg(F.max("ord").alias("ord"))
    return E.test_links(files)


_DEFS_SQL = "SELECT 'p::d' || (p_size % 9) || '/f' || (p_partkey % 40) || '.py::' || 'fn' || (p_partkey % 60) || p_partkey AS qn, 'fn' || (p_partkey % 60) AS simple, p_partkey AS ord, p_partkey % 40 AS f, p_size % 9 AS d FROM part"


@query(f"""WITH defs AS (SELECT 'p::d' || d || '/f' || f || '.py::' || simple AS qn, simple, min(ord) AS ord FROM ({_DEFS_SQL}) GROUP BY ALL),
calls AS (SELECT event_id AS call_id, 'd' || (user_id % 9) || '/f' || (user_id % 40) || '.py' AS rel, 'fn' || (event_id % 70) AS callee, 'p::d' || (user_id % 9) || '/f' || (user_id % 40) || '.py::main' AS caller FROM events),
imports AS (SELECT DISTINCT rel, 'd' || (call_id % 5) || '.f' AS module, callee, 1 AS io FROM calls WHERE call_id % 11 = 0),
cand AS (SELECT c.*, d.qn, d.ord, count(*) OVER (PARTITION BY call_id) AS n, (SELECT min(io) FROM imports i WHERE i.rel = c.rel AND i.callee = c.callee AND contains(d.qn, replace(i.module, '.', '/'))) AS io FROM calls c JOIN defs d ON d.simple = c.callee),
lcp AS (SELECT *, (SELECT coalesce(min(i) - 1, least(length(qn), length(caller))) FROM range(1, 200) t(i) WHERE i <= least(length(qn), length(caller)) AND qn[i] <> caller[i]) AS pre FROM cand),
r AS (SELECT *, CASE WHEN io IS NOT NULL THEN 1 WHEN starts_with(qn, 'p::' || rel || '::') THEN 2 WHEN n = 1 THEN 3 ELSE 4 END AS rank FROM lcp),
best AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rank, CASE WHEN rank = 4 THEN -pre ELSE coalesce(io, 0) END, CASE WHEN rank = 4 THEN -ord ELSE ord END) AS rn FROM r)
SELECT call_id, qn AS target_qn, [0.95, 0.9, 0.75, 0.55][rank]::DOUBLE AS confidence FROM best WHERE rn = 1""")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    simple = F.concat(F.lit("fn"), (F.col("p_partkey") % 60).cast("string"))
    qn = F.concat(F.lit("p::d"), (F.col("p_size") % 9).cast("string"), F.lit("/f"), (F.col("p_partkey") % 40).cast("string"), F.lit(".py::"), simple)
    defs = part.select(qn.alias("qualified_name"), simple.alias("simple_name"), F.col("p_partkey").alias("ord")).groupBy("qualified_name", "simple_name").agg(F.min("ord").alias("ord"))
    rel = F.concat(F.lit("d"), (F.col("user_id") % 9).cast("string"), F.lit("/f"), (F.col("user_id") % 40).cast("string"), F.lit(".py"))
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.lit("p").alias("project"), rel.alias("rel_path"), F.concat(F.lit("fn"), (F.col("event_id") % 70).cast("string")).alias("callee"), F.concat(F.lit("p::"), rel, F.lit("::main")).alias("caller_qn"))
    imports = calls.filter("call_id % 11 = 0").select("rel_path", F.concat(F.lit("d"), (F.col("call_id") % 5).cast("string"), F.lit(".f")).alias("module_path"), F.lit(None).cast("string").alias("alias"), F.array("callee").alias("names"), F.lit(1).cast("long").alias("ord")).distinct()
    return B.resolve_calls(calls, defs, imports).drop("strategy")


@query("""WITH a AS (SELECT o_custkey AS k, max(o_totalprice) AS v, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS v, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.k = b.k WHERE b.k IS NULL OR a.k IS NULL OR a.v <> b.v OR a.n <> b.n""")
def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    side = lambda odd: orders.filter(F.year("o_orderdate") % 2 == odd).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("mtime_s"), F.count(F.lit(1)).alias("size"))
    return Q.detect_changes(side(0), side(1), keys=("key",))


@query("""SELECT doc_id, i::BIGINT AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE regexp_matches(l, '[Ll]icense|password')""")
def search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel_path"), F.col("text").alias("content"))
    return Q.search_code(docs, "[Ll]icense|password", limit=None).select(F.col("rel_path").alias("doc_id"), F.col("line").cast("long").alias("line"), "text")


@query("""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, greatest(doc_id % 5 + 2 - 1, 1)::BIGINT AS start, least(doc_id % 5 + 3 + 1, len(l))::BIGINT AS "end", array_to_string(l[greatest(doc_id % 5 + 2 - 1, 1):least(doc_id % 5 + 3 + 1, len(l))], chr(10)) AS source FROM d""")
def source_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A definition of two lines in each document, further down in some, with one line around; '' below a document's end."""
    docs = table(spark, sf_dir, "documents")
    files = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("rel_path"), F.col("text").alias("content"))
    start = F.col("doc_id") % 5 + 2
    nodes = docs.select(F.lit("f").alias("qualified_name"), F.col("doc_id").cast("string").alias("file_path"), start.alias("line_start"), (start + 1).alias("line_end"))
    found = Q.snippet(nodes, files, "f", context=1)
    return found.select(F.col("file_path").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "source")


@query("""SELECT band, count(*) AS n FROM (SELECT CASE WHEN c >= 0.7 THEN 'high' WHEN c >= 0.45 THEN 'medium' WHEN c >= 0.25 THEN 'speculative' ELSE 'low' END AS band FROM (SELECT greatest(0.0, least(1.0, l_discount * 12 - 0.1)) AS c FROM lineitem)) GROUP BY band""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(S.band(S.clamped(F.col("l_discount") * 12 - 0.1)).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
