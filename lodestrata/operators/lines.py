"""Line and row operators on ordered groups: repeats, similar lines, truncation, neighbourhoods, runs, top groups.

All take a DataFrame with grouping columns (by) and an order column, and are windows over one group; groups are
the unit of distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits that markers in outputs depend on.
HEAD, TAIL, LONGEST, SIMILAR = 100, 50, 200, 5
LINT_KEPT, LINT_EXAMPLES = 3, 2
SPINNERS = "⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏⣾⣽⣻⢿⡿⣟⣯⣷"
BARS = "━█▓░▒■□●○#=->{}/|"


def lines_of(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, ord (from 0), line."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))


def _w(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[a-zA-Z]", "")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(\n\s*){3,}", "\n\n")


def universal_clean(text: Column) -> Column:
    return F.trim(collapse_blanks(strip_ansi(text)))


def is_progress(line: Column) -> Column:
    """A spinner, or a line of which half is bar characters."""
    bare = F.trim(line)
    bars = F.length(F.regexp_replace(bare, f"[^{BARS.replace('-', '')}-]", ""))  # the minus stands last, where it is itself
    return F.when(bare == "", False).otherwise(F.exists(F.split(F.lit(SPINNERS), ""), lambda c: (c != "") & F.contains(line, c)) | (bars * 2 >= F.length(bare)))


def collapse_repeats(rows: DataFrame, by: list[str], order: str = "ord", value: str = "line") -> DataFrame:
    """Neighbouring equal values that are not blank become one, with ' (xN)': by, first order, value, times."""
    w = _w(by, order)
    same = (F.col(value) == F.lag(value).over(w)) & (F.trim(value) != "")
    marked = rows.withColumn("__run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    runs = marked.groupBy(*by, "__run").agg(F.min(order).alias(order), F.min(value).alias(value), F.count(F.lit(1)).alias("times"))
    said = F.when(F.col("times") > 1, F.concat(value, F.lit(" (x"), F.col("times").cast("string"), F.lit(")"))).otherwise(F.col(value))
    return runs.select(*by, order, said.alias(value), "times")


def digits_masked(line: Column) -> Column:
    return F.regexp_replace(line, "[0-9]+", "N")


def numeric_heavy(line: Column) -> Column:
    """Nearly a third digits, or a rate, a share, a time."""
    bare = F.trim(line)
    digits = F.length(F.regexp_replace(bare, "[^0-9]", ""))
    return (bare != "") & ((digits >= 0.3 * F.length(bare)) | bare.rlike(r"%|B/s|ETA|--:--:--|[0-9]+:[0-9]+:[0-9]+"))


def collapse_similar(rows: DataFrame, by: list[str], order: str = "ord", value: str = "line", least: int = SIMILAR) -> DataFrame:
    """In runs of lines that differ in digits only, those from the first numeric-heavy line on become, if least or
    more, the first, a marker and the last."""
    w = _w(by, order)
    masked = digits_masked(F.col(value))
    same = masked == F.lag(masked).over(w)
    marked = rows.withColumn("__run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    run = Window.partitionBy(*by, "__run")
    marked = marked.withColumn("__at", F.row_number().over(run.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(run))
    marked = marked.withColumn("__from", F.min(F.when(numeric_heavy(F.col(value)), F.col("__at"))).over(run))
    fold = F.coalesce(F.col("__n") - F.col("__from") + 1 >= least, F.lit(False)) & (F.col("__at") > F.col("__from")) & (F.col("__at") < F.col("__n"))
    marker = F.format_string("... (%d similar lines)", F.col("__n") - F.col("__from") - 1)
    said = F.when(fold, marker).otherwise(F.col(value))
    return marked.filter(~fold | (F.col("__at") == F.col("__from") + 1)).select(*by, order, said.alias(value))


def truncate_middle(rows: DataFrame, by: list[str], order: str = "ord", value: str = "line", head: int = HEAD, tail: int = TAIL, longest: int = LONGEST) -> DataFrame:
    """Groups of over longest rows keep head and tail, with a marker between."""
    w = _w(by, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    marked = rows.withColumn("__at", F.row_number().over(w)).withColumn("__n", n)
    cut = F.col("__n") > longest
    marker = F.format_string("... (%d lines truncated, %d total)", F.col("__n") - head - tail, F.col("__n"))
    kept = marked.filter(~cut | (F.col("__at") <= head + 1) | (F.col("__at") > F.col("__n") - tail))
    return kept.select(*by, order, F.when(cut & (F.col("__at") == head + 1), marker).otherwise(F.col(value)).alias(value))


def neighbourhood(rows: DataFrame, by: list[str], order: str, hit: Column, around: int = 2, head: int = 10, tail: int = 10) -> DataFrame:
    """Rows of a group's head, tail, and within around rows of a hit; skipped: rows left out just before each."""
    w = _w(by, order)
    near = F.max(F.when(hit, 1).otherwise(0)).over(w.rowsBetween(-around, around)) == 1
    marked = rows.withColumn("__at", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("__near", near)
    kept = marked.filter(F.col("__near") | (F.col("__at") <= head) | (F.col("__at") > F.col("__n") - tail))
    return kept.withColumn("skipped", (F.col("__at") - F.coalesce(F.lag("__at").over(w), F.lit(0)) - 1).cast("long")).drop("__at", "__n", "__near")


def gap_marker(skipped: Column) -> Column:
    return F.when(skipped == 1, F.lit("... (1 line skipped)")).when(skipped > 1, F.format_string("... (%d lines skipped)", skipped))


def head_more(rows: DataFrame, by: list[str], order: str, value: str, keep: int, threshold: int) -> DataFrame:
    """Groups of over threshold rows keep the first keep rows and a row '... (N more)'."""
    w = _w(by, order)
    marked = rows.withColumn("__at", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    cut = F.col("__n") > threshold
    kept = marked.filter(~cut | (F.col("__at") <= keep + 1))
    return kept.select(*by, order, F.when(cut & (F.col("__at") == keep + 1), F.format_string("... (%d more)", F.col("__n") - keep)).otherwise(F.col(value)).alias(value))


def top_groups(rows: DataFrame, group: str, order: str, groups: int = 15, each: int = 3) -> DataFrame:
    """The first each rows of the largest groups: rows with size and place. Equal sizes go by first appearance.

    Groups are counted and cut to the top before rows are numbered, so only the kept groups are sorted.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("__first"))
    best = sizes.orderBy(F.desc("size"), "__first").limit(groups)
    kept = rows.join(F.broadcast(best), group)
    place = F.row_number().over(_w([group], order))
    return kept.withColumn("place", place).filter(F.col("place") <= each).drop("__first")


def runs(rows: DataFrame, by: list[str], order: str, keys: list[str]) -> DataFrame:
    """Maximal runs of equal keys: by, keys, first and last order, length."""
    w = _w(by, order)
    key = F.struct(*keys)
    same = key.eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1)
    marked = rows.withColumn("__run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return marked.groupBy(*by, "__run", *keys).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def status_counts(rows: DataFrame, by: list[str], status: str) -> DataFrame:
    """by, n, told: 'A:3, M:1' sorted by status."""
    each = rows.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    told = F.array_sort(F.collect_list(F.concat_ws(":", F.col(status), F.col("n").cast("string"))))
    return each.groupBy(*by).agg(F.sum("n").alias("n"), F.array_join(told, ", ").alias("told"))


def lint_groups(rows: DataFrame, by: list[str], order: str, rule: str, file: str, kept: int = LINT_KEPT, examples: int = LINT_EXAMPLES) -> DataFrame:
    """Findings of a rule with over kept rows become a header, examples and a count of the rest.

    Columns: by, rule, rule_order (first appearance), place, said: the row's file, or the header's or elision's words.
    """
    w = Window.partitionBy(*by, rule)
    files = rows.groupBy(*by, rule).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(file).alias("files"), F.min(order).alias("rule_order"), F.min(file).alias("only"))
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(order))).join(files, [*by, rule])
    small = placed.filter(F.col("n") <= kept).select(*by, rule, "rule_order", F.col("place").cast("long").alias("place"), F.col(file).alias("said"))
    shown = placed.filter((F.col("n") > kept) & (F.col("place") <= examples)).select(*by, rule, "rule_order", F.col("place").cast("long").alias("place"), F.col(file).alias("said"))
    large = files.filter(F.col("n") > kept)
    header = F.concat_ws(" ", F.col("n").cast("string"), F.lit("occurrences"), F.when(F.col("files") == 1, F.col("only")).otherwise(F.concat_ws(" ", F.col("files").cast("string"), F.lit("files"))))
    heads = large.select(*by, rule, "rule_order", F.lit(0).cast("long").alias("place"), header.alias("said"))
    rests = large.select(*by, rule, "rule_order", F.lit(examples + 1).cast("long").alias("place"), F.format_string("... (%d more)", F.col("n") - examples).alias("said"))
    return small.unionByName(shown).unionByName(heads).unionByName(rests)


def quoted(value: Column) -> Column:
    """A field of a compact row: null is empty; quoted, quotes doubled, only if it holds ; { } [ ] or a line end."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"[;{}\[\]\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def compact_rows(columns: list[str]) -> Column:
    return F.concat_ws(";", *[quoted(F.col(c)) for c in columns])


def redacted(key: Column, value: Column) -> Column:
    """The value, hidden where its key tells of a secret."""
    return F.when(F.upper(key).rlike("KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL|AUTH|PRIVATE"), "[REDACTED]").otherwise(value)


def shorter_of(compact: Column, raw: Column) -> Column:
    """The compact form, but only where it is shorter."""
    return F.when(F.length(compact) < F.length(raw), compact).otherwise(raw)
