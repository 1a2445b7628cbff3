"""Token accounting: a fact row for each call, rollups over it, baselines that calls are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The model of what a call would have cost.
OVERHEAD_PER_TURN, CALLS_PER_TURN = 23_350, 4
LINE_CHARS, GREP_LINES, GREP_LIMIT, READ_LINES, READ_PREFIX = 80, 7, 250, 50, 8
DEFS_PER_FILE, CHECKABLE, REF_CHECK_BYTES = 8, 0.6, 500
TRANSFORMS = ("clean_html", "compact_json", "search_markdown", "compact_output")


def baseline_tokens(tool: Column, raw_size: Column, result_chars: Column, n_results: Column, n_files: Column, has_project: Column) -> Column:
    """What a call's content would have cost without the tool; null inputs count as unknown."""
    defs = n_files * DEFS_PER_FILE
    dead = F.floor((F.least(defs * 25, F.lit(GREP_LIMIT * LINE_CHARS)) + F.floor(defs * CHECKABLE) * REF_CHECK_BYTES) / 4)
    hop = 3 * LINE_CHARS + READ_LINES * (LINE_CHARS + READ_PREFIX)
    transform = F.when(raw_size > 0, F.floor(raw_size / 4)).otherwise(F.floor(result_chars * 2 / 4))
    return (
        F.when(tool.isin(*TRANSFORMS), transform)
        .when(~F.coalesce(has_project, F.lit(False)), 0)
        .when(tool == "find_dead_code", dead)
        .when(tool == "find_routes", F.coalesce(F.greatest(F.floor(n_results * 2 * LINE_CHARS / 4), F.lit(200)), F.lit(500)))
        .when(tool == "search_graph", F.coalesce(F.greatest(F.floor(n_results * GREP_LINES * LINE_CHARS / 4), F.lit(100)), F.lit(200)))
        .when(tool == "trace_fan", F.floor(F.coalesce(F.greatest(n_results, F.lit(2)), F.lit(3)) * hop / 4))
        .when(tool.isin("get_graph_schema", "detect_changes", "get_architecture"), 500)
        .when(tool.isin("index_status", "list_projects", "delete_project"), 50)
        .otherwise(0)
        .cast("long")
    )


def architecture_baseline(listing_chars: Column, readme_size: Column, init_size: Column, source_sizes: Column) -> Column:
    """Tokens of a file listing, a readme, a package's start and the first hundred lines of up to five files."""
    numbered = lambda size, lines: size + F.greatest(F.floor(size / LINE_CHARS), F.lit(lines)) * READ_PREFIX
    readme = F.when(readme_size.isNotNull(), numbered(F.least(readme_size, F.lit(2000 * LINE_CHARS)), 1)).otherwise(0)
    init = F.when(init_size.isNotNull(), numbered(init_size, 1)).otherwise(0)
    few = F.transform(F.slice(source_sizes, 1, 5), lambda s: F.least(s, F.lit(100 * LINE_CHARS)))
    sources = F.aggregate(few, F.lit(0).cast("long"), lambda t, s: t + s + F.least(F.lit(100), F.floor(s / LINE_CHARS)) * READ_PREFIX)
    return F.greatest(F.floor((listing_chars + readme + init + sources) / 4), F.lit(500)).cast("long")


def baseline_calls(tool: Column, n_files: Column, n_nodes: Column) -> Column:
    """How many plain calls one call stands for."""
    return (
        F.when(tool == "index_repository", 0)
        .when(tool == "get_architecture", 8)
        .when(tool == "find_dead_code", F.when(n_files.isNotNull(), 1 + F.floor(n_files * DEFS_PER_FILE * CHECKABLE)).otherwise(10))
        .when(tool == "trace_fan", F.when(n_nodes.isNotNull(), F.greatest((n_nodes + 1) * 2, F.lit(2))).otherwise(6))
        .otherwise(1)
        .cast("int")
    )


def record_calls(calls: DataFrame) -> DataFrame:
    """Fact rows with saved tokens and calls; missing counters are 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    rows = calls.select(*[c for c in calls.columns if c not in ("content_tokens", "baseline_tokens", "baseline_calls")], *map(zero, ("content_tokens", "baseline_tokens", "baseline_calls")))
    return rows.withColumn("saved_tokens", F.col("baseline_tokens") - F.col("content_tokens")).withColumn("calls_saved", F.greatest(F.col("baseline_calls") - 1, F.lit(0)))


def bash_calls(compressed: DataFrame) -> DataFrame:
    """Fact rows for compressed commands (hint, raw_text, compact_text): tool compress:<hint>, agent hook."""
    tokens = lambda c: F.floor(F.octet_length(c) / 4).cast("long")
    return compressed.select(F.concat(F.lit("compress:"), F.coalesce("hint", F.lit("auto"))).alias("tool"), F.lit("hook").alias("agent"), tokens("compact_text").alias("content_tokens"), tokens("raw_text").alias("baseline_tokens"), F.lit(1).alias("baseline_calls"))


def context_tokens(calls: Column, content: Column) -> Column:
    """Tokens of a whole conversation: overhead each turn, content once and again in half of the later turns."""
    turns = F.ceil(calls / CALLS_PER_TURN)
    return F.when(calls > 0, turns * OVERHEAD_PER_TURN + content + F.floor(content * (turns - 1) / 2)).otherwise(0).cast("long")


def savings_pct(content: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, F.bround((1 - content / baseline) * 100, 1)).otherwise(0.0)


def efficiency(content: Column, baseline: Column) -> Column:
    return F.when(content > 0, F.bround(baseline / content, 1)).otherwise(0.0)


def usage_rollup(facts: DataFrame, keys: tuple[str, ...] = ("tool", "chat_id", "agent")) -> DataFrame:
    """Totals overall, by each key, and by chat and tool, in one pass of grouping sets. facts from record_calls.

    Columns: level (total, or the keys joined by +), keys (null where not grouped), counters and ratios.
    """
    tool, chat, agent = keys
    sums = [F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(c) for c in ("content_tokens", "baseline_tokens", "saved_tokens", "baseline_calls", "calls_saved")]]
    sets = [[], [F.col(tool)], [F.col(chat)], [F.col(chat), F.col(tool)], [F.col(agent)]]
    out = facts.groupingSets(sets, F.col(tool), F.col(chat), F.col(agent)).agg(F.grouping_id(F.col(tool), F.col(chat), F.col(agent)).alias("gid"), *sums)
    level = F.when(F.col("gid") == 7, "total").when(F.col("gid") == 3, "tool").when(F.col("gid") == 5, "chat").when(F.col("gid") == 1, "chat+tool").otherwise("agent")
    return out.select(
        level.alias("level"), *keys, "queries", "content_tokens", "baseline_tokens", "saved_tokens", "baseline_calls", "calls_saved",
        savings_pct(F.col("content_tokens"), F.col("baseline_tokens")).alias("savings_pct"), efficiency(F.col("content_tokens"), F.col("baseline_tokens")).alias("efficiency"),
        context_tokens(F.col("queries"), F.col("content_tokens")).alias("context_tokens"),
    )


def savings_line(saved: Column, pct: Column, total: Column) -> Column:
    return F.format_string("[saved ~%s content tokens (%s%%) | session total: %s content tokens saved]", F.format_number(saved, 0), pct.cast("string"), F.format_number(total, 0))


def migrate_counters(old: DataFrame) -> DataFrame:
    """Counter rows of an earlier layout (version, tool, counters...) to the present one: missing columns are 0;
    rows of unknown versions are left out."""
    want = ("queries", "content_tokens", "baseline_tokens", "baseline_calls", "calls_saved")
    known = old.filter(F.col("version").isin(3, 4))
    return known.select(F.lit(4).alias("version"), "tool", *[(F.coalesce(F.col(c).cast("long"), F.lit(0)) if c in old.columns else F.lit(0).cast("long")).alias(c) for c in want])
