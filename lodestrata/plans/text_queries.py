"""Line, text and usage operators over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata import schema as S
from lodestrata.functions import commands, compact_json, html, markdown
from lodestrata.functions.output import engine
from lodestrata.operators import lines as L
from lodestrata.operators import usage as U
from lodestrata.plans.star_graph import table
from lodestrata.sources.workspace import spread

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def kept(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return kept


#: Lines' places: order and line number, then the part, as several lines of an order share a number.
_PLACE = "((l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey)"


def _place() -> Column:
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("ord")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents"


@query("SELECT lang, count(*) AS n, sum(strlen(coalesce(text, '')) // 4)::BIGINT AS tokens, sum(length(coalesce(text, '')) // 4)::BIGINT AS char_tokens FROM documents GROUP BY lang")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(S.token_estimate(F.col("text"))).alias("tokens"), F.sum(S.char_tokens(F.col("text"))).alias("char_tokens"))


@query(f"""WITH l AS ({_LINES}), m AS (SELECT *, sum(CASE WHEN line = prev AND trim(line) <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY ord) AS prev FROM l))
SELECT doc_id, min(ord)::BIGINT AS ord, min(line) || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS line, count(*) AS times FROM m GROUP BY doc_id, run""")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collapse_repeats(L.lines_of(table(spark, sf_dir, "documents"), keep=("doc_id",)), ["doc_id"])


_EVENT_LINE = "CASE WHEN user_id % 3 = 0 THEN 'done ' || (event_id % 5 + 10) || '% of ' || event_type WHEN user_id % 3 = 1 THEN event_type || ' step ' || (event_id % 7) ELSE 'n ' || event_id END"


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda n: n.cast("string")
    line = (
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("done "), e(F.col("event_id") % 5 + 10), F.lit("% of "), "event_type"))
        .when(F.col("user_id") % 3 == 1, F.concat("event_type", F.lit(" step "), e(F.col("event_id") % 7)))
        .otherwise(F.concat(F.lit("n "), e(F.col("event_id"))))
    )
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), line.alias("line"))


@query(f"""WITH l AS (SELECT user_id, event_id AS ord, {_EVENT_LINE} AS line FROM events), k AS (SELECT *, regexp_replace(line, '[0-9]+', 'N', 'g') AS mask FROM l),
r AS (SELECT *, sum(CASE WHEN mask = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ord) AS run FROM (SELECT *, lag(mask) OVER (PARTITION BY user_id ORDER BY ord) AS prev FROM k)),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ord) AS pos, count(*) OVER (PARTITION BY user_id, run) AS n,
      regexp_matches(line, '%|B/s|ETA|--:--:--|[0-9]+:[0-9]+:[0-9]+') OR length(regexp_replace(trim(line), '[^0-9]', '', 'g')) >= 0.3 * length(trim(line)) AS heavy FROM r),
f AS (SELECT *, min(CASE WHEN heavy THEN pos END) OVER (PARTITION BY user_id, run) AS start FROM h),
g AS (SELECT *, coalesce(n - start + 1 >= 5, false) AND pos > start AND pos < n AS fold FROM f)
SELECT user_id, ord, CASE WHEN fold THEN '... (' || (n - start - 1) || ' similar lines)' ELSE line END AS line FROM g WHERE NOT fold OR pos = start + 1""")
def similar_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.collapse_similar(_event_lines(spark, sf_dir), ["user_id"])


@query(f"""WITH l AS (SELECT user_id, event_id AS ord, {_EVENT_LINE} AS line FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM l)
SELECT user_id, ord, CASE WHEN n > 40 AND pos = 21 THEN '... (' || (n - 30) || ' lines truncated, ' || n || ' total)' ELSE line END AS line FROM m WHERE n <= 40 OR pos <= 21 OR pos > n - 10""")
def head_tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.truncate_middle(_event_lines(spark, sf_dir), ["user_id"], head=20, tail=10, longest=40)


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id) AS n,
  max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT * FROM e WHERE near = 1 OR pos <= 10 OR pos > n - 10)
SELECT user_id, event_id, event_type, pos - coalesce(lag(pos) OVER (PARTITION BY user_id ORDER BY pos), 0) - 1 AS skipped FROM k""")
def error_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return L.neighbourhood(rows, ["user_id"], "event_id", F.col("event_type") == "error")


@query("""WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events), r AS (SELECT *, sum(CASE WHEN event_type = prev THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM r GROUP BY user_id, run, event_type""")
def run_length_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", ["event_type"])


@query(f"""WITH r AS (SELECT l_suppkey, l_returnflag AS rule, {_PLACE} AS ord, l_shipmode_like AS file FROM (SELECT *, 'f' || (l_partkey % 5) AS l_shipmode_like FROM lineitem)),
p AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, rule ORDER BY ord) AS place, count(*) OVER (PARTITION BY l_suppkey, rule) AS n, min(ord) OVER (PARTITION BY l_suppkey, rule) AS rule_order FROM r),
g AS (SELECT l_suppkey, rule, min(ord) AS rule_order, count(*) AS n, count(DISTINCT file) AS files, min(file) AS only_file FROM r GROUP BY ALL)
SELECT l_suppkey, rule, rule_order, place, file AS said FROM p WHERE n <= 3 OR place <= 2
UNION ALL SELECT l_suppkey, rule, rule_order, 0, n || ' occurrences ' || CASE WHEN files = 1 THEN only_file ELSE files || ' files' END FROM g WHERE n > 3
UNION ALL SELECT l_suppkey, rule, rule_order, 3, '... (' || (n - 2) || ' more)' FROM g WHERE n > 3""")
def lint_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("rule"), _place(), F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("file"))
    return L.lint_groups(rows, ["l_suppkey"], "ord", "rule", "file")


@query(f"""WITH g AS (SELECT l_suppkey, count(*) AS size, min({_PLACE}) AS f FROM lineitem GROUP BY l_suppkey ORDER BY size DESC, f LIMIT 15),
r AS (SELECT l_suppkey, {_PLACE} AS ord, size, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_PLACE}) AS place FROM lineitem JOIN g USING (l_suppkey))
SELECT l_suppkey, ord, size, place FROM r WHERE place <= 3""")
def topk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", _place())
    return L.top_groups(rows, "l_suppkey", "ord").withColumn("place", F.col("place").cast("long"))


@query("""SELECT o_orderpriority, sum(n)::BIGINT AS n, string_agg(o_orderstatus || ':' || n, ', ' ORDER BY o_orderstatus) AS told FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.status_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus")


@query(f"""WITH m AS (SELECT l_suppkey, {_PLACE} AS ord, l_returnflag AS v, row_number() OVER w AS pos, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_PLACE}))
SELECT l_suppkey, ord, CASE WHEN n > 20 AND pos = 16 THEN '... (' || (n - 15) || ' more)' ELSE v END AS v FROM m WHERE n <= 20 OR pos <= 16""")
def head_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", _place(), F.col("l_returnflag").alias("v"))
    return L.head_more(rows, ["l_suppkey"], "ord", "v", 15, 20)


_KEYS = ("api_key", "home", "auth_mode", "path", "db_password")


@query("""SELECT event_id, k AS key, CASE WHEN regexp_matches(upper(k), 'KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL|AUTH|PRIVATE') THEN '[REDACTED]' ELSE props END AS value
FROM (SELECT event_id, props, ['api_key', 'home', 'auth_mode', 'path', 'db_password'][event_id % 5 + 1] AS k FROM events)""")
def env_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"), L.redacted(key, F.col("props")).alias("value"))


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') || ';' || event_type || ';' || CASE WHEN contains(props, '{') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS row FROM events""")
def compact_json_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat_ws(";", compact_json.flat_rows(F.col("props"), ["k"]), L.quoted(F.col("event_type")), L.quoted(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", row.alias("row"))


@query("""SELECT event_id, '[event_id;event_type;value]' || chr(10) || event_id || ';' || event_type || ';' || user_id AS compact FROM events""")
def compact_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.to_json(F.struct("event_id", "event_type", F.col("user_id").alias("value")))
    return table(spark, sf_dir, "events").select("event_id", compact_json.compact_json_column(doc).alias("compact"))


@query("""SELECT user_id, '[event_id;event_type]' || chr(10) || string_agg(event_id || ';' || event_type, chr(10) ORDER BY event_id) AS compact FROM events GROUP BY user_id""")
def compact_json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(rows).alias("doc")).select("user_id", compact_json.compact_if_shorter_column(F.col("doc")).alias("compact"))


@query("""SELECT user_id, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT user_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['a', event_type] ELSE ['b'] END) AS k FROM events) GROUP BY user_id""")
def json_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.when(F.col("event_id") % 2 == 0, F.format_string('{"a":1,"%s":2}', "event_type")).otherwise(F.lit('{"b":1}'))
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), doc.alias("json"))
    return compact_json.key_union(rows, ["user_id"]).select("user_id", F.array_join(F.array_sort("keys"), ",").alias("keys"))


_COMMANDS = ("git diff --stat", "cat src/main.py", "pytest -q", "ls | wc", "rg foo", "cargo check", "less x", "npm run build", "echo hi", "  kubectl get pods", "git stash list", "head -3 notes.md")


@query("""WITH c AS (SELECT event_id, ['git diff --stat', 'cat src/main.py', 'pytest -q', 'ls | wc', 'rg foo', 'cargo check', 'less x', 'npm run build', 'echo hi', '  kubectl get pods', 'git stash list', 'head -3 notes.md'][event_id % 12 + 1] AS command FROM events)
SELECT event_id, CASE WHEN contains(command, '|') THEN NULL WHEN trim(command) LIKE 'git diff%' THEN 'git-diff' WHEN command LIKE 'pytest%' THEN 'pytest' WHEN command LIKE 'rg %' THEN 'rg' WHEN command LIKE 'cargo check%' THEN 'cargo-build'
 WHEN command LIKE 'npm run%' THEN 'npm' WHEN trim(command) LIKE 'kubectl%' THEN 'kubectl' WHEN command = 'git stash list' THEN 'git-stash' END AS hint FROM c""")
def command_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (F.col("event_id") % 12 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", commands.command_hint(command).alias("hint"))


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    calls = turns.select(
        F.concat(F.lit("t"), (F.col("turn") % 4).cast("string")).alias("tool"), F.col("conv_id").alias("chat_id"), F.col("role").alias("agent"),
        S.token_estimate(F.col("text")).alias("content_tokens"), (S.token_estimate(F.col("text")) * 3 + 5).alias("baseline_tokens"), (F.col("turn") % 3).alias("baseline_calls"),
    )
    return U.record_calls(calls)


@query("""WITH c AS (SELECT 't' || (turn % 4) AS tool, conv_id AS chat_id, role AS agent, strlen(coalesce(text, '')) // 4 AS c, strlen(coalesce(text, '')) // 4 * 3 + 5 AS b, turn % 3 AS k FROM conversations),
g AS (SELECT grouping_id(tool, chat_id, agent) AS gid, tool, chat_id, agent, count(*) AS queries, sum(c)::BIGINT AS content_tokens, sum(b)::BIGINT AS baseline_tokens, sum(b - c)::BIGINT AS saved_tokens, sum(k)::BIGINT AS baseline_calls, sum(greatest(k - 1, 0))::BIGINT AS calls_saved
FROM c GROUP BY GROUPING SETS ((), (tool), (chat_id), (chat_id, tool), (agent)))
SELECT CASE gid WHEN 7 THEN 'total' WHEN 3 THEN 'tool' WHEN 5 THEN 'chat' WHEN 1 THEN 'chat+tool' ELSE 'agent' END AS level, tool, chat_id, agent, queries, content_tokens, baseline_tokens, saved_tokens, baseline_calls, calls_saved,
 (ceil(queries / 4) * 23350 + content_tokens + floor(content_tokens * (ceil(queries / 4) - 1) / 2))::BIGINT AS context_tokens FROM g""")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.usage_rollup(_usage(spark, sf_dir)).drop("savings_pct", "efficiency")


@query("""WITH c AS (SELECT role AS agent, sum(strlen(coalesce(text, '')) // 4) AS c, sum(strlen(coalesce(text, '')) // 4 * 3 + 5) AS b FROM conversations GROUP BY role)
SELECT agent, CASE WHEN b > 0 THEN round((1 - c::DOUBLE / b) * 100, 1) ELSE 0.0 END::DOUBLE AS savings_pct, CASE WHEN c > 0 THEN round(b::DOUBLE / c, 1) ELSE 0.0 END::DOUBLE AS efficiency FROM c""")
def savings_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.usage_rollup(_usage(spark, sf_dir)).filter("level = 'agent'").select("agent", "savings_pct", "efficiency")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, sum(strlen(coalesce(text, '')) // 4)::BIGINT AS t FROM conversations GROUP BY conv_id)
SELECT conv_id, (ceil(n / 4) * 23350 + t + floor(t * (ceil(n / 4) - 1) / 2))::BIGINT AS tokens FROM c""")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(S.token_estimate(F.col("text"))).alias("t"))
    return each.select("conv_id", U.context_tokens(F.col("n"), F.col("t")).alias("tokens"))


_TOOLS = ("compact_json", "find_dead_code", "find_routes", "trace_fan", "get_architecture", "index_status", "search_graph", "index_repository")


@query("""WITH e AS (SELECT event_id, ['compact_json', 'find_dead_code', 'find_routes', 'trace_fan', 'get_architecture', 'index_status', 'search_graph', 'index_repository'][event_id % 8 + 1] AS tool, event_id % 97 AS n FROM events)
SELECT event_id, CASE tool WHEN 'compact_json' THEN CASE WHEN n * 37 > 0 THEN n * 37 // 4 ELSE 0 END WHEN 'find_dead_code' THEN (least(n * 8 * 25, 20000) + floor(n * 8 * 0.6)::BIGINT * 500) // 4 WHEN 'find_routes' THEN greatest(n * 160 // 4, 200)
 WHEN 'search_graph' THEN greatest(n * 560 // 4, 100) WHEN 'trace_fan' THEN greatest(n, 2) * 4640 // 4 WHEN 'get_architecture' THEN 500 WHEN 'index_status' THEN 50 ELSE 0 END::BIGINT AS tokens,
 CASE tool WHEN 'index_repository' THEN 0 WHEN 'get_architecture' THEN 8 WHEN 'find_dead_code' THEN 1 + floor(n * 8 * 0.6) WHEN 'trace_fan' THEN greatest((n + 1) * 2, 2) ELSE 1 END::BIGINT AS calls FROM e""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("event_id") % 8 + 1).cast("int"))
    n = F.col("event_id") % 97
    tokens = U.baseline_tokens(tool, n * 37, F.lit(0), n, n, F.lit(True))
    return table(spark, sf_dir, "events").select("event_id", tokens.alias("tokens"), U.baseline_calls(tool, n, n).cast("long").alias("calls"))


def _cut_sql(tags: tuple[str, ...]) -> str:
    out = "html"
    for tag in tags:
        out = f"regexp_replace({out}, '<{tag}(\\s[^>]*)?>[\\s\\S]*?</{tag}>', '', 'gi')"
    return out


@query(f"SELECT page_id, {_cut_sql(('script', 'style', 'head', 'nav', 'footer'))} AS html FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.without_elements(F.col("html")).alias("html"))


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html.clean_html_column(F.col("html")).alias("markdown"))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html.clean_html_column(F.col("html"), "text").alias("text"))


@query()
def html_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", html.clean_html_column(F.col("html"), "minimal").alias("html"))


def _as_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines of even number become headers, of levels 1 to 3 in turn."""
    lines = F.split("text", "\n")
    said = F.transform(lines, lambda line, k: F.when(k % 2 == 0, F.concat(F.repeat(F.lit("#"), (k / 2 % 3 + 1).cast("int")), F.lit(" "), line)).otherwise(line))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL"))
    return docs.select("doc_id", F.array_join(said, "\n").alias("text"))


_SECTIONS_SQL = f"""l AS ({_LINES} WHERE text IS NOT NULL), s AS (SELECT doc_id, ord // 2 AS sec, max(CASE WHEN ord % 2 = 0 THEN trim(line) END) AS title, coalesce(max(CASE WHEN ord % 2 = 1 THEN trim(line) END), '') AS content, (ord // 2 % 3 + 1) AS level FROM l GROUP BY doc_id, ord // 2)"""


@query(f"WITH {_SECTIONS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS sec_id, level::BIGINT AS level, title FROM s WHERE title <> ''")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.sections_of(_as_markdown(spark, sf_dir), "text", ("doc_id",))
    return found.select("doc_id", F.col("sec_id").cast("long").alias("sec_id"), F.col("level").cast("long").alias("level"), "title")


@query(f"""WITH {_SECTIONS_SQL}, w AS (SELECT doc_id, sec, ((CASE WHEN contains(lower(title), 'the') THEN 1.0 WHEN contains(lower(content), 'the') THEN 0.3 ELSE 0.0 END) + (CASE WHEN contains(lower(title), 'of') THEN 1.0 WHEN contains(lower(content), 'of') THEN 0.3 ELSE 0.0 END)) / 2 AS mean, level,
  greatest(1, length(content) // 4) AS tokens FROM s WHERE title <> ''), d AS (SELECT doc_id, greatest(1, length(text) // 4) AS budget FROM documents),
k AS (SELECT *, round(mean::DOUBLE + 0.05 * level, 3) AS score FROM w WHERE mean > 0), t AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM k),
r AS (SELECT t.*, budget, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sec) AS rank FROM t JOIN d USING (doc_id) WHERE score >= top * 0.75),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY rank) AS spent FROM r WHERE rank <= 5), v AS (SELECT *, min(CASE WHEN spent > budget AND rank > 2 THEN rank END) OVER (PARTITION BY doc_id) AS cut FROM u)
SELECT doc_id, sec::BIGINT AS sec, rank FROM v WHERE cut IS NULL OR rank < cut""")
def md_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.lines_of(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), keep=("doc_id",))
    side = lambda odd, v: F.max(F.when(F.col("ord") % 2 == odd, F.trim(v)))
    sections = lines.groupBy("doc_id", F.floor(F.col("ord") / 2).alias("sec")).agg(side(0, F.col("line")).alias("title"), F.coalesce(side(1, F.col("line")), F.lit("")).alias("content"))
    sections = sections.filter("title <> ''").withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("content") / 4)))
    scored = sections.withColumn("score", markdown.score_column(F.col("title"), F.col("content"), F.col("sec") % 3 + 1, ["the", "of"]))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("budget"))
    ranked = markdown.rank_hits(scored.join(docs, "doc_id"), ["doc_id"], "sec", "tokens", "budget")
    return ranked.select("doc_id", F.col("sec").cast("long").alias("sec"), F.col("rank").cast("long").alias("rank"))


@query()
def markdown_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.hits_of(_as_markdown(spark, sf_dir).withColumn("query", F.lit("the of")), "text", "query", ("doc_id",))


@query()
def markdown_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _as_markdown(spark, sf_dir)
    return docs.select("doc_id", markdown.search_markdown_column(F.col("text"), F.lit("the of")).alias("answer"))


@query("SELECT doc_id, regexp_replace(text, '(\\n\\s*){3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def collapse_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", L.collapse_blanks(L.strip_ansi(F.col("text"))).alias("text"))


_BAR_LINE = "repeat('█', event_id % 9) || repeat('░', event_id % 4) || repeat('x', event_id % 11) || ' ' || event_type"


@query(f"WITH l AS (SELECT event_id, {_BAR_LINE} AS line FROM events) SELECT event_id, line FROM l WHERE trim(line) <> '' AND length(regexp_replace(trim(line), '[^━█▓░▒■□●○#=>{{}}/|-]', '', 'g')) * 2 >= length(trim(line))")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = lambda c, n: F.repeat(F.lit(c), (F.col("event_id") % n).cast("int"))
    line = F.concat(bar("█", 9), bar("░", 4), bar("x", 11), F.lit(" "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).filter(L.is_progress(F.col("line")))


@query("""SELECT user_id, '[id;who:{kind;size};tags:[{k;v}]]' || chr(10) || string_agg(event_id || ';{' || event_type || ';' || user_id || '};' || CASE WHEN event_id % 2 = 0 THEN '[{' || event_type || '}]' ELSE '[{' || event_id || '}]' END, chr(10) ORDER BY event_id) AS compact
FROM events GROUP BY user_id HAVING bool_or(event_id % 2 = 0) AND arg_min(event_id % 2, event_id) = 0 AND bool_or(event_id % 2 = 1)""")
def compact_json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and tables within rows; the tables' columns are the union of their keys (users whose first event is even)."""
    even = F.col("event_id") % 2 == 0
    doc = F.when(even, F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("size")).alias("who"), F.array(F.struct(F.col("event_type").alias("k"))).alias("tags"))))
    doc = doc.otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("size")).alias("who"), F.array(F.struct(F.col("event_id").alias("v"))).alias("tags"))))
    rows = F.array_sort(F.collect_list(F.struct("event_id", doc.alias("doc"))))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(rows.alias("rows")).filter("rows[0].event_id % 2 = 0 AND exists(rows, x -> x.event_id % 2 = 1)")
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda x: x["doc"]), ","), F.lit("]"))
    return users.select("user_id", compact_json.compact_json_column(text).alias("compact"))


@query()
def generic_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as outputs of unknown commands."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", engine.compact_output_column(F.col("text")).alias("text"))


def _rendered(spark: SparkSession, sf_dir: str, line: Column, head: str = "", tail: str = "") -> DataFrame:
    """A text for each user: head, a line for each event in order, tail."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"])
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(rows, "\n").alias("text"), F.count(F.lit(1)).alias("n"))
    return events.select("user_id", F.concat(F.lit(head), "text", F.format_string(tail, "n") if "%d" in tail else F.lit(tail)).alias("text"))


def _parsed(texts: DataFrame, hint: str | None, verbose: bool = False) -> DataFrame:
    found = texts.select("user_id", engine.parse_output_column(F.col("text"), hint, verbose).alias("p"))
    return found.select("user_id", "p.tool", "p.summary", F.size("p.rows").cast("long").alias("n_rows"))


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def output_query(name: str, hint: str, sql: str, line: Callable[[], Column], head: str = "", tail: str = "") -> None:
    """A parser over a text for each user, against counts that SQL makes from the events themselves."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _parsed(_rendered(spark, sf_dir, line(), head, tail), hint)

    QUERIES[name] = run
    SQL[name] = sql


_N = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id"
_PLURAL = "n || CASE WHEN n = 1 THEN ' {0}' ELSE ' {0}s' END"
_GROUPED = "least(sum(CASE WHEN k <= 3 THEN k ELSE 4 END), 1000000)::BIGINT"

output_query(
    "parse_output_ruff", "ruff",
    f"SELECT user_id, 'ruff' AS tool, sum(k) || CASE WHEN sum(k) = 1 THEN ' issue' ELSE ' issues' END || ' across ' || count(*) || CASE WHEN count(*) = 1 THEN ' rule' ELSE ' rules' END AS summary, {_GROUPED} AS n_rows FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) GROUP BY user_id",
    lambda: F.concat(F.lit("src/f"), _s(F.col("event_id") % 3), F.lit(".py:"), _s(F.col("event_id")), F.lit(":1: E"), _s(F.ascii(F.col("event_type")) * 1000 + F.length(F.col("event_type"))), F.lit(" "), F.col("event_type")),
)
output_query(
    "parse_output_mypy", "mypy",
    f"SELECT user_id, 'mypy' AS tool, sum(k) || CASE WHEN sum(k) = 1 THEN ' issue' ELSE ' issues' END || ' across ' || count(*) || CASE WHEN count(*) = 1 THEN ' rule' ELSE ' rules' END AS summary, {_GROUPED} AS n_rows FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) GROUP BY user_id",
    lambda: F.concat(F.lit("m.py:"), _s(F.col("event_id")), F.lit(": error: wrong  ["), F.col("event_type"), F.lit("]")),
)
output_query(
    "parse_output_tsc", "tsc",
    f"SELECT user_id, 'tsc' AS tool, sum(k) || CASE WHEN sum(k) = 1 THEN ' issue' ELSE ' issues' END || ' across ' || count(*) || CASE WHEN count(*) = 1 THEN ' rule' ELSE ' rules' END AS summary, {_GROUPED} AS n_rows FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) GROUP BY user_id",
    lambda: F.concat(F.lit("a.ts("), _s(F.col("event_id")), F.lit(",1): error TS"), _s(F.ascii(F.col("event_type")) * 1000 + F.length(F.col("event_type"))), F.lit(": "), F.col("event_type")),
)
output_query("parse_output_env", "env", f"SELECT user_id, 'env-redact' AS tool, n || ' vars (' || e || ' redacted)' AS summary, n AS n_rows FROM ({_N})", lambda: F.concat(F.lit("V"), _s(F.col("event_id")), F.when(F.col("event_type") == "error", "_KEY").otherwise(""), F.lit("="), F.col("event_type")))
output_query("parse_output_freeze", "pip-freeze", f"SELECT user_id, 'package-list' AS tool, n || ' packages' AS summary, CASE WHEN n > 20 THEN 16 ELSE n END AS n_rows FROM ({_N})", lambda: F.concat(F.col("event_type"), _s(F.col("event_id")), F.lit("=="), _s(F.col("event_id") % 7), F.lit(".0")))
output_query("parse_output_pip_list", "pip-list", f"SELECT user_id, 'package-list' AS tool, n || ' packages' AS summary, CASE WHEN n > 20 THEN 16 ELSE n END AS n_rows FROM ({_N})", lambda: F.concat(F.lit("p"), _s(F.col("event_id")), F.lit("   1.0")), "Package    Version\n---------- -------\n")
output_query("parse_output_log", "git-log", f"SELECT user_id, 'git-log' AS tool, CASE WHEN n = 1 THEN '1 entry' WHEN n <= 10 THEN n || ' entries' ELSE '10 entries (showing 10 of ' || n || ')' END AS summary, least(n, 10) AS n_rows FROM ({_N})", lambda: F.concat(F.lpad(F.lower(F.hex(F.col("event_id"))), 8, "0"), F.lit(" "), F.col("event_type")))
output_query("parse_output_stash", "git-stash", f"SELECT user_id, 'git-stash' AS tool, n || CASE WHEN n = 1 THEN ' stash' ELSE ' stashes' END AS summary, CASE WHEN n > 10 THEN 8 ELSE n END AS n_rows FROM ({_N})", lambda: F.concat(F.lit("stash@{"), _s(F.col("event_id")), F.lit("}: On main: "), F.col("event_type")))
output_query("parse_output_pods", "kubectl", f"SELECT user_id, 'kubectl' AS tool, n || ' pods (' || (n - e - v) || ' healthy' || CASE WHEN v > 0 THEN ', ' || v || ' completed' ELSE '' END || CASE WHEN e > 0 THEN ', ' || e || ' unhealthy' ELSE '' END || ')' AS summary, e AS n_rows FROM ({_N})", lambda: F.concat(F.rpad(F.concat(F.lit("p"), _s(F.col("event_id"))), 20, " "), F.lit("1/1    "), F.rpad(F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "view", "Completed").otherwise("Running"), 12, " "), F.lit("5d")), "NAME                READY  STATUS      AGE\n")
output_query("parse_output_docker_ps", "docker-ps", f"SELECT user_id, 'docker-ps' AS tool, n || ' containers (' || (n - e) || ' running' || CASE WHEN e > 0 THEN ', ' || e || ' stopped' ELSE '' END || ')' AS summary, n - e AS n_rows FROM ({_N})", lambda: F.concat(F.rpad(_s(F.col("event_id")), 15, " "), F.lit("img     "), F.when(F.col("event_type") == "error", "Exited (1)   ").otherwise("Up 2 hours   "), F.lit("name")), "CONTAINER ID   IMAGE   STATUS       NAMES\n")
output_query("parse_output_grep", "grep", "SELECT user_id, 'search-results' AS tool, sum(k) || ' matches across ' || count(*) || ' files' AS summary, sum(CASE WHEN k > 3 THEN 4 ELSE k END)::BIGINT AS n_rows FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL) GROUP BY user_id", lambda: F.concat(F.col("event_type"), F.lit(".py:"), _s(F.col("event_id")), F.lit(":x")))
output_query("parse_output_blame", "git-blame", "WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT user_id, 'git-blame' AS tool, count(*) || ' lines, ' || count(DISTINCT event_type) || CASE WHEN count(DISTINCT event_type) = 1 THEN ' author, ' ELSE ' authors, ' END || sum((event_type IS DISTINCT FROM prev)::INT) || CASE WHEN sum((event_type IS DISTINCT FROM prev)::INT) = 1 THEN ' range' ELSE ' ranges' END AS summary, sum((event_type IS DISTINCT FROM prev)::INT)::BIGINT AS n_rows FROM e GROUP BY user_id", lambda: F.concat(F.lpad(F.lower(F.hex(F.crc32(F.col("event_type").cast("binary")))), 8, "0"), F.lit(" ("), F.col("event_type"), F.lit("  2025-03-01 10:00:00 +0000  "), _s(F.col("event_id")), F.lit(") x")))
output_query("parse_output_docker_logs", "docker-logs", f"SELECT user_id, 'docker-logs' AS tool, n || ' log lines, ' || e || CASE WHEN e = 1 THEN ' error' ELSE ' errors' END AS summary, rows AS n_rows FROM ({_N}) JOIN (WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n, max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM events), k AS (SELECT *, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM x WHERE near = 1 OR pos <= 10 OR pos > n - 10 OR n <= 20) SELECT user_id, count(*) + count(*) FILTER (gap > 1) AS rows FROM k GROUP BY user_id) USING (user_id)", lambda: F.concat(F.lit("2025-01-01T00:00:00Z "), F.when(F.col("event_type") == "error", "ERROR failed").otherwise(F.concat(F.lit("INFO "), F.col("event_type")))))
output_query("parse_output_status", "git-status", "SELECT user_id, 'git-status' AS tool, 'Files: ' || count(*) || ' (' || array_to_string(list_filter([CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN 'M:' || count(*) FILTER (event_type <> 'error') END, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN '?:' || count(*) FILTER (event_type = 'error') END], lambda x: x IS NOT NULL), ', ') || ')' AS summary, CASE WHEN count(*) > 8 THEN 1 ELSE count(*) END AS n_rows FROM events GROUP BY user_id", lambda: F.concat(F.when(F.col("event_type") == "error", "?? ").otherwise(" M "), F.lit("src/f"), _s(F.col("event_id")), F.lit(".py")))
