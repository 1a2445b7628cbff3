"""Row layouts of the code graph, the usage facts, and constants that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE = "id long, label string, name string, qualified_name string, file_path string, line_start int, line_end int, properties map<string,string>"
EDGE = "source_id long, target_id long, edge_type string, confidence double, properties map<string,string>, ord long"
FILE = "project string, path string, rel_path string, language string, content string, mtime_s long, size long"
FILE_HASH = "project string, rel_path string, mtime_s long, size long"
DEFINITION = "name string, qualified_name string, label string, line_start int, line_end int"
CALL = "callee_name string, line int, enclosing_qn string"
IMPORT = "module_path string, alias string, names array<string>, line int"
ROUTE_HINT = "def_qn string, handler_name string, route_path string, route_method string, line int"
USAGE = "name string, line int, enclosing_qn string"
TOOL_CALL = "call_ord long, chat_id string, agent string, started_at string, tool string, content_tokens long, baseline_tokens long, baseline_calls int"

# Labels, edge types and confidences that stored graphs and filters use.
LABELS = ("Project", "Folder", "File", "Function", "Method", "Class", "Interface", "Struct", "Enum", "Variable", "Route", "Test")
EDGE_TYPES = (
    "CONTAINS_FILE", "CONTAINS_FOLDER", "CALLS", "CALLED_BY", "USES", "USED_BY", "IMPORTS", "TYPE_REF", "TESTS", "TESTS_FILE",
    "CO_CHANGED", "SIMILAR_TO", "HANDLES", "CONFIGURES", "DATA_FLOWS",
)
IMPORT_MAP, SAME_MODULE, UNIQUE_NAME, SUFFIX_MATCH = 0.95, 0.90, 0.75, 0.55
CHARS_PER_TOKEN = 4


def clamped(confidence: Column) -> Column:
    """Confidence within 0 and 1; null stays null."""
    return F.when(confidence.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.45, "medium").when(confidence >= 0.25, "speculative").when(confidence.isNotNull(), "low")


def token_estimate(text: Column) -> Column:
    """UTF-8 bytes in whole fours; null counts as empty."""
    return F.floor(F.coalesce(F.octet_length(text), F.lit(0)) / CHARS_PER_TOKEN).cast("long")


def char_tokens(text: Column) -> Column:
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / CHARS_PER_TOKEN).cast("long")
