"""All queries of the library itself, by name, with their SQL."""

from __future__ import annotations

from lodestrata.plans import graph_queries, output_queries, source_queries, text_queries

QUERIES = graph_queries.QUERIES | text_queries.QUERIES | output_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = graph_queries.SQL | text_queries.SQL | output_queries.SQL | source_queries.SQL
