"""Extraction, indexing and streaming operators over sources rendered from the test tables, with SQL for their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.index import build_graph
from lodestrata.plans.star_graph import table
from lodestrata.sources import extract as X
from lodestrata.sources import files as S
from lodestrata.streaming.watch import event_counts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def kept(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return kept


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each brand: a route handler for each part that calls another one, or what nobody defines."""
    key = F.col("p_partkey")
    s = lambda c: c.cast("string")
    line = F.concat(
        F.when(key % 5 == 0, F.concat(F.lit('@app.get("/p/'), s(key), F.lit('")\n'))).otherwise(""), F.lit("def f"), s(key), F.lit("():\n    "),
        F.when(key % 3 == 0, F.concat(F.lit("f"), s(key + 1))).otherwise(F.concat(F.lit("missing"), s(key % 7))), F.lit("()\n"),
    )
    rows = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("line")))), lambda x: x["line"])
    files = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(rows, "").alias("content"))
    name = F.concat(F.lit("src/"), F.regexp_replace("p_brand", "[^0-9]", ""), F.lit(".py"))
    return files.select(F.lit("shop").alias("project"), name.alias("rel_path"), F.lit("Python").alias("language"), "content")


_FILE = "'src/' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.py'"


@query(f"""WITH p AS (SELECT {_FILE} AS rel_path, p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS d FROM part)
SELECT rel_path, 'f' || k AS name, 'shop::' || rel_path || '::f' || k AS qualified_name, 'Function' AS label, (sum(2 + d) OVER (PARTITION BY rel_path ORDER BY k) - 1)::BIGINT AS line_start FROM p""")
def extract_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.exploded(X.extracted(_sources(spark, sf_dir)), "definitions")
    return found.select("rel_path", "name", "qualified_name", "label", F.col("line_start").cast("long").alias("line_start"))


@query(f"SELECT {_FILE} AS rel_path, CASE WHEN p_partkey % 3 = 0 THEN 'f' || (p_partkey + 1) ELSE 'missing' || (p_partkey % 7) END AS callee, 'shop::' || {_FILE} || '::f' || p_partkey AS caller_qn FROM part")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exploded(X.extracted(_sources(spark, sf_dir)), "calls").select("rel_path", "callee", "caller_qn")


@query(f"SELECT {_FILE} AS rel_path, 'f' || p_partkey AS handler_name, '/p/' || p_partkey AS route_path, 'GET' AS route_method FROM part WHERE p_partkey % 5 = 0")
def extract_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exploded(X.extracted(_sources(spark, sf_dir)), "hints").select("rel_path", "handler_name", "route_path", "route_method")


@query(f"""WITH p AS (SELECT {_FILE} AS f, p_partkey AS k FROM part), c AS (SELECT a.k FROM p a JOIN p b ON b.k = a.k + 1 WHERE a.k % 3 = 0)
SELECT 'node' AS what, 'Project' AS kind, 1::BIGINT AS n UNION ALL SELECT 'node', 'Folder', 1 UNION ALL SELECT 'node', 'File', count(DISTINCT f) FROM p UNION ALL SELECT 'node', 'Function', count(*) FROM p
UNION ALL SELECT 'node', 'Route', count(*) FROM p WHERE k % 5 = 0 UNION ALL SELECT 'edge', 'HANDLES', count(*) FROM p WHERE k % 5 = 0
UNION ALL SELECT 'edge', 'CONTAINS_FOLDER', 1 UNION ALL SELECT 'edge', 'CONTAINS_FILE', count(DISTINCT f) + count(*) FROM p UNION ALL SELECT 'edge', 'CALLS', count(*) FROM c""")
def index_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, _ = build_graph(_sources(spark, sf_dir))
    count = lambda df, what, kind: df.groupBy(F.lit(what).alias("what"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "node", "label").unionByName(count(edges, "edge", "edge_type"))


@query("""SELECT url, regexp_matches(regexp_replace(url, '^.*?://', ''), '(^|/)(dist|target|vendor|tmp|venv|node_modules|es)/') AS pruned FROM pages""")
def pruned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files; a vendor directory stands for es."""
    path = F.regexp_replace(F.regexp_replace("url", "^.*?://", ""), "/es/", "/vendor/")
    return table(spark, sf_dir, "pages").select("url", S.pruned(path).alias("pruned"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation, over the table as one batch."""
    return event_counts(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
